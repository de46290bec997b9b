"""DuckDB SQL of the operators that SQL can express."""

from contrast.llm import negatives, secrets, spelling, thresholds

# The mixing query: the same bisection as a recursive table, then running sums over the
# permutation of each source's last pass.
MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, '=' || source AS named,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS tokens,
         md5(coalesce(text, '')) AS text_md5
  FROM documents
), s AS (
  SELECT coalesce(named, '-') AS key, any_value(source) AS source, sum(tokens)::BIGINT AS tokens
  FROM d GROUP BY 1
), l AS (
  SELECT list(tokens::DOUBLE ORDER BY tokens) AS t, sum(tokens)::DOUBLE AS total,
         max(tokens)::DOUBLE AS most, min(tokens)::DOUBLE AS least, count(*)::DOUBLE AS n FROM s
), e(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE low END, CASE WHEN ok THEN high ELSE m END
  FROM (
    SELECT i, low, high, m, ln(list_sum(x)) - list_sum(list_transform(x, lambda v: v * ln(v))) / list_sum(x)
           >= 0.95 * ln(n) AS ok
    FROM (SELECT e.*, (low + high) / 2 AS m, n, list_transform(t, lambda v: pow(v / total, (low + high) / 2)) AS x
          FROM e, l WHERE i < 20)
  )
), r(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE low END, CASE WHEN ok THEN high ELSE m END
  FROM (SELECT i, low, high, (low + high) / 2 AS m,
               pow(least / most, (1 - (low + high) / 2) - 1) <= 1.5 AS ok
        FROM r, l WHERE i < 20)
), a AS (
  SELECT greatest(
    CASE WHEN ln(1) + ln(n) * 0 + (ln(list_sum(list_transform(t, lambda v: v / total)))
         - list_sum(list_transform(t, lambda v: v / total * ln(v / total)))) >= 0.95 * ln(n)
         THEN 1 ELSE (SELECT max(low) FROM e WHERE i = 20) END,
    1 - CASE WHEN pow(least / most, -1) <= 1.5 THEN 1 ELSE (SELECT max(low) FROM r WHERE i = 20) END
  )::DOUBLE AS exponent FROM l
), f AS (
  SELECT exponent, total, most, list_sum(list_transform(t, lambda v: pow(v / total, exponent))) AS norm FROM l, a
), w AS (
  SELECT key, tokens,
         round(pow(tokens / total, exponent) / norm * (most / (pow(most / total, exponent) / norm)))::BIGINT AS target
  FROM s, f
), p AS (
  SELECT d.*, coalesce(named, '-') AS key, target // w.tokens AS whole, target % w.tokens AS rest,
         ('0x' || md5(concat_ws(':', '11', target // w.tokens, coalesce(doc_id::VARCHAR, '-'), text_md5))[1:12])::BIGINT
           AS last_place
  FROM d JOIN w ON coalesce(d.named, '-') = w.key
), u AS (
  SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY last_place, doc_id, text_md5
                              ROWS UNBOUNDED PRECEDING) AS upto FROM p
), x AS (
  SELECT *, min(CASE WHEN upto <= rest THEN 1 ELSE 0 END) OVER (PARTITION BY key, doc_id, text_md5) AS fits FROM u
), n AS (
  SELECT doc_id, source, key, text_md5, unnest(range(whole + fits)) AS pass FROM x
), o AS (
  SELECT doc_id, source, pass,
         ('0x' || md5(concat_ws(':', '11', pass, coalesce(doc_id::VARCHAR, '-'), text_md5))[1:12])::BIGINT AS place
  FROM n
)
SELECT doc_id, source, pass, place >> 36 AS block, place FROM o
"""



def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _hits(pattern):
    """Rows (doc, start, hit, value) of the hits of a pattern, laid between the pieces."""
    group = ", 2" if pattern == secrets.ASSIGN else ""
    p = _quoted(pattern)
    return f"""
    SELECT doc, n, hit, value,
      coalesce(list_sum([length(x) FOR x IN pieces[1:n]]), 0)
      + coalesce(list_sum([length(x) FOR x IN hits[1:n - 1]]), 0) AS start
    FROM (
      SELECT doc, unnest(range(1, len(hits) + 1)) AS n, unnest(hits) AS hit, unnest(vals) AS value, pieces, hits
      FROM (SELECT doc, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}) AS hits,
                   regexp_extract_all(t, {p}{group}) AS vals FROM d)
    )"""


def _secrets():
    """Spans by pattern, and windows counted from scratch, joined where they touch."""
    spans = []
    for rank, (kind, pattern) in enumerate(
        (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX))
    ):
        long = f"length({'value' if kind == 'assign' else 'hit'}) >= {secrets.LEAST[kind]}"
        spans.append(
            f"SELECT doc, {rank} AS rank, start, start + length(hit) AS stop FROM ({_hits(pattern)}) WHERE {long}"
        )
    window, bits = secrets.WINDOW, secrets.micro_bits()
    # Parts left out become blanks, which no window may hold.
    part, between = _quoted(secrets.ALLOWED_PART), _quoted(secrets.SEPARATOR)
    blanked = f"""array_to_string([
        CASE WHEN regexp_matches(parts[k], {part}) THEN repeat(' ', length(parts[k])) ELSE parts[k] END
        || coalesce(signs[k], '') FOR k IN range(1, len(parts) + 1)], '')"""
    for rank, (kind, pattern, _, least) in enumerate(secrets.CLASSES, len(secrets.LEAST)):
        word = f"lower({blanked})" if kind == "entropy_hex" else blanked
        spans.append(f"""
        SELECT doc, {rank} AS rank, min(start + i) AS start, max(start + i) + {window} AS stop FROM (
          SELECT doc, n, start, i, sum(fresh) OVER (PARTITION BY doc, n ORDER BY i) AS island FROM (
            SELECT doc, n, start, i,
              CASE WHEN i - lag(i) OVER (PARTITION BY doc, n ORDER BY i) <= {window} THEN 0 ELSE 1 END AS fresh
            FROM (
              SELECT doc, n, start, i, substr(word, i + 1, {window}) AS part FROM (
                SELECT doc, n, start, {word} AS word, unnest(range(0, length(hit) - {window - 1})) AS i
                FROM (SELECT *, string_split_regex(hit, {between}) AS parts, regexp_extract_all(hit, {between}) AS signs
                      FROM ({_hits(pattern)}) WHERE NOT regexp_matches(hit, {_quoted(secrets.ALLOWED)}))))
            WHERE NOT contains(part, ' ') AND list_sum([{bits}[length(part) - length(replace(part, c, '')) + 1]
                            FOR c IN list_distinct(string_split(part, ''))]) <= {secrets.micro_limit(least)}))
        GROUP BY doc, n, island""")
    kinds = "[" + ", ".join(_quoted(kind) for kind in secrets.KINDS) + "]"
    text = f"{kinds}[rank + 1] || ':' || start || ':' || stop"
    order = "ORDER BY start, rank, stop"
    count = ",\n".join(
        f"count(*) FILTER (rank = {i}) AS n_{kind}" for i, kind in enumerate(secrets.LEAST)
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(spans)})
    SELECT any_value(doc_id) AS doc_id, {count},
      sha256(coalesce(string_agg({text}, ',' {order}) FILTER (rank < {len(secrets.LEAST)}), '')) AS base_sha256,
      coalesce(string_agg({text}, ',' {order}) FILTER (rank IS NOT NULL), '') AS spans,
      count(*) FILTER (rank >= {len(secrets.LEAST)}) AS n_entropy
    FROM d LEFT JOIN s USING (doc) GROUP BY doc"""


# All pairs of one label, and everything that links reach.
ROTATION = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), sound AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND list_bool_and([e IS NOT NULL AND isfinite(e) FOR e IN x]) AND list_bool_or([e <> 0 FOR e IN x])
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id,
  vec_id = min(other) AS kept
FROM reach LEFT JOIN counted ON vec_id = a GROUP BY vec_id
"""


# Every anchor against every row, ranked by windows.
NEGATIVES = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), sound AS MATERIALIZED (
  SELECT r, vec_id AS id, label, [floor(e * {negatives.SCALE})::BIGINT FOR e IN x] AS q FROM v
  WHERE list_bool_and([true] || [coalesce(isfinite(e) AND abs(e) < {negatives.LARGEST}, false) FOR e IN x])
), met AS MATERIALIZED (
  SELECT a.r AS anchor, a.id AS anchor_id, b.r AS row, b.id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM sound a JOIN sound b ON len(a.q) = len(b.q) AND a.r <> b.r
  WHERE a.id % {negatives.EVERY} = 0
), good AS (
  SELECT * FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, row) <= {negatives.POSITIVES}
), bad AS (
  SELECT good.anchor_id, good.id AS positive_id, met.id AS negative_id, good.score AS positive_score,
    met.score AS negative_score,
    row_number() OVER (PARTITION BY good.anchor, good.row ORDER BY met.score DESC, met.id, met.row)::INTEGER AS rank
  FROM good JOIN met ON good.anchor = met.anchor AND NOT met.same
    AND {negatives.LOW} * good.score <= 100 * met.score AND met.score <= good.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM bad WHERE rank <= {negatives.NEGATIVES}
"""

# CRC by table; near words by leaving out each code point; chains as a recursive table.
SPELLING = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents
), runs AS (
  SELECT head, run, count(*) AS n FROM found WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || flatten([CASE WHEN unicode(c) < 128
    THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END FOR c IN string_split(head || run, '')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc
), noisy AS (
  SELECT CASE WHEN h % {spelling.NOISE} <> 0 THEN run
    ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= {spelling.LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS other FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.TIMES} * n THEN other END AS form,
    CASE WHEN m >= {spelling.TIMES} * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL
  SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.onward = formed.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE onward IS NULL) USING (word)
"""


def _thresholds():
    """Counts from lists and windows, and binomial sums term by term."""
    space = r"\x20\x09-\x0D"
    rules = thresholds.RULES
    rating = {
        rule: f"CASE WHEN {under} > 0 THEN {over} * 1000 // {under} ELSE 0 END" for rule, (over, under, _) in rules.items()
    }
    grid = ", ".join(
        f"('{rule}', {i}, {cutoff})" for rule, (_, _, cuts) in rules.items() for i, cutoff in enumerate(cuts)
    )
    ratings = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{rule}' AS rule, {value} AS rating FROM passed" for rule, value in rating.items()
    )
    risk = thresholds.RISK / len(rules)
    failed = ", ".join(
        f"CASE WHEN {value} >= (SELECT cutoff FROM chosen c WHERE c.stratum = counted.stratum AND rule = '{rule}') "
        f"THEN '{rule}' END"
        for rule, value in rating.items()
    )
    return f"""
    WITH d AS MATERIALIZED (
      SELECT row_number() OVER () AS doc, doc_id, coalesce('=' || lang, '-') AS stratum, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w
      FROM documents
    ), wins AS (
      SELECT doc, i, count(*) OVER (PARTITION BY doc, win) AS times FROM (
        SELECT doc, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
        FROM (SELECT doc, w, unnest(range(1, len(w) - 1)) AS i FROM d))
    ), again AS (
      SELECT doc, count(DISTINCT i + k) AS n FROM wins, range(3) AS shift(k) WHERE times > 1 GROUP BY doc
    ), counted AS MATERIALIZED (
      SELECT *, n_words < {thresholds.LEAST_WORDS} OR 100 * n_repeat_words > {thresholds.MOST_REPEATED} * n_words AS base_failed
      FROM (
        SELECT doc_id, stratum, len(w) AS n_words,
          length(regexp_replace(t, '[{space}]+', '', 'g')) AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
          len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
          coalesce(again.n, 0) AS n_repeat_words
        FROM (SELECT *, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^{space}]')] AS lines FROM d)
        LEFT JOIN again USING (doc))
    ), rated AS (
      SELECT doc_id, min(quality) > 0 AS good FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
    ), passed AS (SELECT * FROM counted WHERE NOT base_failed),
    known AS MATERIALIZED (SELECT stratum, rule, good, rating FROM ({ratings}) JOIN rated USING (doc_id)),
    tested AS (
      SELECT stratum, rule, i, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m,
        count(*) FILTER (good AND rating >= cutoff) AS k, count(*) FILTER (NOT good AND rating >= cutoff) AS caught
      FROM known JOIN (VALUES {grid}) AS grid(rule, i, cutoff) USING (rule) GROUP BY ALL
    ), admitted AS (
      SELECT *, bool_and(k < n * {risk!r} AND list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
          + j * ln({risk!r}) + (n - j) * ln(1 - {risk!r})) FOR j IN range(0, k + 1)])
          <= {thresholds.DOUBT!r} / ({len(rules)} * (SELECT count(DISTINCT stratum) FROM known)))
        OVER (PARTITION BY stratum, rule ORDER BY i) AS fits
      FROM tested
    ), chosen AS MATERIALIZED (
      SELECT stratum, rule, cutoff FROM admitted WHERE fits AND caught * n > k * m
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught * n - k * m DESC, i) = 1
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
      NOT base_failed AND failed_rules = '' AS kept
    FROM (SELECT *, concat_ws(',', {failed}) AS failed_rules FROM counted)"""


ORACLES = {
    "op1_secrets": _secrets(),
    "op8_mixing": MIXING,
    "op9_rotation_codes": ROTATION,
    "op11_hard_negatives": NEGATIVES,
    "op12_spelling": SPELLING,
    "op13_thresholds": _thresholds(),
}
