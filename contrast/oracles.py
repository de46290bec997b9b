"""DuckDB SQL for the same results, written from the definitions.

The statements densify, rank and join in the plain way; nothing here follows the
Spark plans. Every floating output is rounded like the Spark side.
"""


def _r(expression, name, digits=6):
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _query(ctes, final, recursive=False):
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + final


# --- fixtures ----------------------------------------------------------------


def _terms(cohort):
    return [
        (
            "tok",
            "SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{M}]+')) AS term "
            "FROM documents",
        ),
        (
            "lng",
            f"""SELECT {cohort} AS cohort,
              CASE l.quality WHEN 1 THEN 'case' WHEN 0 THEN 'control' ELSE 'baseline' END AS grp,
              term AS feature_id, CAST(t.doc_id AS VARCHAR) AS sample_id, count(*) AS cnt
            FROM tok t LEFT JOIN labels l ON t.doc_id = l.doc_id WHERE term <> ''
            GROUP BY ALL""",
        ),
    ]


CORPUS = _terms("'corpus'")
BY_LANG = _terms("lang")


def _retail(cohort, feature="p_brand"):
    return [
        (
            "lng",
            f"""SELECT {cohort} AS cohort,
              CASE c_mktsegment WHEN 'BUILDING' THEN 'case' WHEN 'HOUSEHOLD' THEN 'control'
                WHEN 'FURNITURE' THEN 'baseline' ELSE 'other' END AS grp,
              {feature} AS feature_id, CAST(o_custkey AS VARCHAR) AS sample_id,
              CAST(sum(l_quantity) AS BIGINT) AS cnt
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN part ON l_partkey = p_partkey
              JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey
            GROUP BY ALL""",
        )
    ]


RETAIL = _retail("'all'")
RETAIL_BY_REGION = _retail("r_name")
BRAND_TYPE = "p_brand || '.' || p_type"

PARTS = [("contrasted", "SELECT * FROM lng WHERE grp IN ('case', 'control')")]

EVENTS = [
    (
        "ev",
        "SELECT event_type AS feature_id, CAST(user_id AS VARCHAR) AS sample_id, count(*) AS cnt "
        "FROM events GROUP BY ALL",
    ),
    (
        "users",
        "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS pos "
        "FROM (SELECT DISTINCT sample_id FROM ev)",
    ),
    (
        "mat",
        """SELECT f.feature_id, u.sample_id, u.pos, coalesce(e.cnt, 0) AS cnt
        FROM (SELECT DISTINCT feature_id FROM ev) f CROSS JOIN users u
        LEFT JOIN ev e ON e.feature_id = f.feature_id AND e.sample_id = u.sample_id""",
    ),
]

EVENT_LABELS = [
    (
        "lab",
        """SELECT DISTINCT CAST(user_id AS VARCHAR) AS sample_id,
          CASE WHEN user_id % 10 = 0 THEN 'Metastatic'
            WHEN user_id % 2 = 1 THEN 'Primary Tumor' ELSE 'Solid Tissue Normal' END AS sample_type
        FROM events""",
    )
]

VECTORS = [
    (
        "vec",
        """SELECT CAST(vec_id AS VARCHAR) AS sample_id, label, i - 1 AS pos,
          CAST(embedding[i] AS DOUBLE) AS v
        FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i
              FROM embeddings)""",
    )
]

SYMBOLS = [
    (
        "sym",
        """SELECT DISTINCT term AS feature_id, replace(upper(term), 'ẞ', 'SS') AS symbol
        FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{M}]+')) AS term FROM benchmark)
        WHERE term <> ''""",
    )
]

PREDICTIONS = [
    (
        "pred",
        """SELECT CAST(quality AS DOUBLE) AS label, CAST(1 - toxic AS DOUBLE) AS prediction,
          CAST(n_chars AS DOUBLE) AS score
        FROM labels JOIN documents USING (doc_id)""",
    )
]


# --- differential analysis ---------------------------------------------------


def _norm(source, prefix=""):
    return [
        (
            f"{prefix}lib",
            f"SELECT cohort, sample_id, sum(cnt) AS lib FROM {source} GROUP BY ALL",
        ),
        (
            f"{prefix}norm",
            f"""SELECT s.*, l.lib, s.cnt / l.lib * 1e6 AS cpm, log2(s.cnt / l.lib * 1e6 + 1) AS y
            FROM {source} s JOIN {prefix}lib l USING (cohort, sample_id)""",
        ),
    ]


EXPRESSED = [
    (
        "need",
        """SELECT cohort, CAST(round_even(0.2::DOUBLE * count(DISTINCT sample_id), 0) AS BIGINT) AS need
        FROM contrasted GROUP BY cohort""",
    ),
    (
        "expressed",
        """SELECT cohort, feature_id, need, count(*) FILTER (cpm > 1) AS n_expressed
        FROM norm JOIN need USING (cohort) GROUP BY ALL HAVING count(*) FILTER (cpm > 1) >= need""",
    ),
]

MOMENTS = [
    ("members", "SELECT DISTINCT cohort, sample_id, grp FROM contrasted"),
    (
        "dense",
        """SELECT e.cohort, e.feature_id, m.grp, coalesce(n.y, 0) AS y
        FROM expressed e JOIN members m ON m.cohort = e.cohort
        LEFT JOIN norm n ON n.cohort = e.cohort AND n.feature_id = e.feature_id
          AND n.sample_id = m.sample_id""",
    ),
    (
        "mom",
        """SELECT cohort, feature_id,
          count(*) FILTER (grp = 'case') AS n_case, count(*) FILTER (grp = 'control') AS n_control,
          avg(y) FILTER (grp = 'case') AS mean_case, avg(y) FILTER (grp = 'control') AS mean_control,
          var_samp(y) FILTER (grp = 'case') AS var_case,
          var_samp(y) FILTER (grp = 'control') AS var_control
        FROM dense GROUP BY ALL HAVING n_case > 0 AND n_control > 0""",
    ),
]

WELCH = [
    (
        "tested",
        """SELECT *, mean_case - mean_control AS log2fc,
          (mean_case - mean_control) / sqrt(se2) AS t_stat,
          se2 * se2 / ((var_case / n_case) ** 2 / (n_case - 1)
            + (var_control / n_control) ** 2 / (n_control - 1)) AS df
        FROM (SELECT *, var_case / n_case + var_control / n_control AS se2 FROM mom)
        WHERE se2 > 0""",
    )
]

PVALUE = [
    (
        "pv",
        """SELECT *, CASE WHEN t_stat = 0 THEN 1.0
          WHEN x > 0.5 AND abs(t_stat) < 6
          THEN 1 - exp(0.5*ln(y) + a*ln(x) + lgamma(a+0.5) - lgamma(a) - lgamma(0.5) - ln(0.5))
            * list_sum(list_transform(range(0, 2000), lambda n:
              exp(lgamma(a+0.5+n) - lgamma(a+0.5) - lgamma(1.5+n) + lgamma(1.5) + n*ln(y))))
          ELSE exp(a*ln(x) + 0.5*ln(y) + lgamma(a+0.5) - lgamma(a) - lgamma(0.5) - ln(a))
            * list_sum(list_transform(range(0, 2000), lambda n:
              exp(lgamma(a+0.5+n) - lgamma(a+0.5) - lgamma(a+1+n) + lgamma(a+1) + n*ln(x))))
          END AS pvalue
        FROM (SELECT *, df / 2 AS a, df / (df + t_stat*t_stat) AS x,
                t_stat*t_stat / (df + t_stat*t_stat) AS y FROM tested)""",
    )
]

FDR = [
    (
        "ranked",
        """SELECT *, row_number() OVER (PARTITION BY cohort
            ORDER BY round(ln(greatest(pvalue, 4.9e-324)), 9), feature_id) AS rnk,
          count(*) OVER (PARTITION BY cohort) AS m FROM pv""",
    ),
    (
        "de",
        """SELECT *, least(1.0, min(pvalue * m / rnk) OVER
          (PARTITION BY cohort ORDER BY rnk DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM ranked""",
    ),
]

TEST = PARTS + _norm("contrasted") + EXPRESSED + MOMENTS + WELCH
DE = TEST + PVALUE + FDR

_DE_COLUMNS = ", ".join(
    [
        "cohort",
        "feature_id",
        *(
            _r(name, name)
            for name in ("log2fc", "t_stat", "df", "pvalue", "fdr", "mean_case", "mean_control")
        ),
        "n_case",
        "n_control",
        "rnk AS rank",
    ]
)
_REPORT = f"cohort, feature_id, {_r('log2fc', 'log2fc')}, {_r('pvalue', 'pvalue')}, {_r('fdr', 'fdr')}"


def _top(source, where, order, k, columns):
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER
      (PARTITION BY cohort ORDER BY {order}) AS k_ FROM {source} WHERE {where})
      WHERE k_ <= {k}"""


# --- target side -------------------------------------------------------------

BASELINE = [
    ("unlabelled", "SELECT * FROM lng WHERE grp = 'baseline'"),
    *_norm("unlabelled", "b"),
    ("bsize", "SELECT cohort, count(DISTINCT sample_id) AS n FROM unlabelled GROUP BY cohort"),
    (
        "bpos",
        """SELECT cohort, feature_id, y, n,
          row_number() OVER (PARTITION BY cohort, feature_id ORDER BY y) AS i,
          count(*) OVER (PARTITION BY cohort, feature_id) AS k
        FROM bnorm JOIN bsize USING (cohort)""",
    ),
    (
        "base",
        """SELECT cohort, feature_id, sum(y) / any_value(n) AS baseline_mean_logcpm,
          coalesce(max(y) FILTER (i = ceil(n / 2) - (n - k)), 0) AS baseline_median_logcpm
        FROM bpos GROUP BY ALL""",
    ),
]

SCORES = [
    (
        "joined",
        """SELECT cohort, feature_id, coalesce(symbol, feature_id) AS symbol, log2fc, fdr,
          baseline_mean_logcpm, baseline_median_logcpm
        FROM de JOIN base USING (cohort, feature_id) LEFT JOIN sym USING (feature_id)""",
    ),
    (
        "scores",
        """SELECT *, z_effect - z_baseline AS target_score FROM (SELECT *,
          (log2fc - avg(log2fc) OVER w) / stddev_samp(log2fc) OVER w AS z_effect,
          (baseline_mean_logcpm - avg(baseline_mean_logcpm) OVER w)
            / stddev_samp(baseline_mean_logcpm) OVER w AS z_baseline
        FROM joined WINDOW w AS (PARTITION BY cohort))""",
    ),
    (
        "limits",
        "SELECT cohort, quantile_cont(baseline_mean_logcpm, 0.25) AS safe_max FROM scores "
        "GROUP BY cohort",
    ),
    (
        "judged",
        """SELECT *, CASE WHEN fdr >= 0.05 OR log2fc <= 1 THEN 'not_significant'
            WHEN baseline_mean_logcpm <= safe_max THEN 'candidate' ELSE 'danger' END AS verdict,
          CASE WHEN fdr >= 0.05 OR log2fc <= 1 THEN 'background'
            WHEN baseline_mean_logcpm <= safe_max THEN 'good' ELSE 'danger' END AS zone
        FROM scores JOIN limits USING (cohort)""",
    ),
]

BY_HALF = _terms("lang || '-' || (t.doc_id % 2)")
RECURRENCE = BY_HALF + DE + BASELINE + SYMBOLS + SCORES
TARGET = BY_LANG + DE + BASELINE + SYMBOLS + SCORES

VOLCANO = BY_LANG + DE + SYMBOLS + [
    (
        "points",
        """SELECT cohort, feature_id, coalesce(symbol, feature_id) AS symbol, log2fc, fdr,
          -log10(greatest(pvalue, 4.9e-324)) AS neglog10p,
          CASE WHEN fdr < 0.05 AND log2fc >= 1 THEN 'up'
            WHEN fdr < 0.05 AND log2fc <= -1 THEN 'down' ELSE 'none' END AS side
        FROM de LEFT JOIN sym USING (feature_id)""",
    )
]

_TARGETS = (
    f"cohort, symbol, {_r('log2fc', 'log2fc')}, "
    f"{_r('baseline_mean_logcpm', 'baseline_mean_logcpm')}, {_r('target_score', 'target_score')}"
)


# --- matrix and scaling ------------------------------------------------------


def _dense(source):
    return f"""SELECT f.cohort, m.grp, f.feature_id, m.sample_id, coalesce(l.cnt, 0) AS cnt
      FROM (SELECT DISTINCT cohort, feature_id FROM {source}) f
      JOIN (SELECT DISTINCT cohort, sample_id, grp FROM {source}) m ON m.cohort = f.cohort
      LEFT JOIN {source} l ON l.cohort = f.cohort AND l.feature_id = f.feature_id
        AND l.sample_id = m.sample_id"""


COLLAPSED = (
    _retail("'all'", BRAND_TYPE)
    + [("full_cells", _dense("lng"))]
    + _norm("full_cells")
    + [
        (
            "merged",
            """SELECT regexp_replace(feature_id, '\\..*$', '') AS feature_id, sample_id, grp,
              avg(y) AS logcpm FROM norm GROUP BY ALL""",
        )
    ]
)

# Squarings that turn the Gramian into the projector of its first component.
SQUARINGS = 26


def _components(k):
    """Components of ``vec`` (sample_id, pos, v), one after the other.

    The Gramian of the standardised positions is squared until only its first component is
    left; that component is taken out of it, and the next one follows. Matrices are lists of
    symmetric rows. The loading of largest size is positive.
    """
    squared = "[[list_dot_product(a, b) / size FOR b IN m] FOR a IN m]"
    taken = (
        "list_transform(g, lambda a, i: list_transform(a, lambda x, j: "
        "x - m[i][j] / weight * (list_sum([list_dot_product(g[r], m[r]) FOR r IN range(1, len(g) + 1)]) / weight)))"
    )
    return [
        (
            "scaled",
            """SELECT sample_id, pos, coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) AS z
            FROM vec WINDOW w AS (PARTITION BY pos)""",
        ),
        (
            "gram",
            """SELECT list(line ORDER BY i) AS g FROM (
              SELECT i, list(value ORDER BY j) AS line FROM (
                SELECT a.pos AS i, b.pos AS j, sum(a.z * b.z) AS value
                FROM scaled a JOIN scaled b USING (sample_id) GROUP BY ALL) GROUP BY i)""",
        ),
        (
            "power",
            f"""SELECT 0 AS c, 0 AS t, g AS m, g FROM gram
            UNION ALL
            SELECT CASE WHEN t < {SQUARINGS} THEN c ELSE c + 1 END, CASE WHEN t < {SQUARINGS} THEN t + 1 ELSE 0 END,
              CASE WHEN t < {SQUARINGS} THEN {squared} ELSE {taken} END,
              CASE WHEN t < {SQUARINGS} THEN g ELSE {taken} END
            FROM (SELECT *, list_sum([list_dot_product(a, a) FOR a IN m]) AS size,
                    list_sum([m[r][r] FOR r IN range(1, len(m) + 1)]) AS weight FROM power)
            WHERE c < {k}""",
        ),
        (
            "loadings",
            """SELECT c, [x / sqrt(m[j][j]) / sqrt(weight) FOR x IN m[j]] AS loading,
              list_sum([list_dot_product(g[r], m[r]) FOR r IN range(1, len(g) + 1)]) / weight AS energy
            FROM (SELECT *, list_position(diagonal, list_max(diagonal)) AS j, list_sum(diagonal) AS weight
                  FROM (SELECT *, [m[r][r] FOR r IN range(1, len(m) + 1)] AS diagonal FROM power
                        WHERE t = %d))""" % SQUARINGS,
        ),
        (
            "components",
            """SELECT sample_id, c, sum(z * loading[pos + 1]) / sqrt(any_value(energy)) AS u
            FROM scaled CROSS JOIN loadings GROUP BY ALL""",
        ),
    ]


def _flat(k):
    return ", ".join(_r(f"max(u) FILTER (c = {i})", f"svd_{i}") for i in range(k))


# The most variable merged features of all cohorts, densified, and their positions.
VARIABLE = (
    _retail("r_name", BRAND_TYPE)
    + [("kept", "SELECT * FROM lng WHERE grp <> 'other'")]
    + _norm("kept")
    + [
        ("ids", "SELECT regexp_replace(feature_id, '\\..*$', '') AS base, count(DISTINCT feature_id) AS n FROM kept GROUP BY 1"),
        (
            "merged",
            """SELECT base, sample_id, coalesce(total, 0) / n AS v
            FROM ids CROSS JOIN (SELECT DISTINCT sample_id FROM kept) LEFT JOIN (
              SELECT regexp_replace(feature_id, '\\..*$', '') AS base, sample_id, sum(y) AS total FROM norm GROUP BY 1, 2
            ) USING (base, sample_id)""",
        ),
        (
            "best",
            """SELECT base, row_number() OVER (ORDER BY var_samp(v) DESC, base) - 1 AS pos
            FROM merged GROUP BY base QUALIFY pos < 20""",
        ),
        ("vec", "SELECT sample_id, pos, v FROM merged JOIN best USING (base)"),
    ]
)

DRAWS = [
    (
        "draws",
        """SELECT cohort, sample_id,
          row_number() OVER (PARTITION BY cohort ORDER BY md5('42:' || sample_id), sample_id) AS i,
          count(*) OVER (PARTITION BY cohort) AS n
        FROM (SELECT DISTINCT cohort, sample_id FROM {source})""",
    )
]


def _draws(source):
    return [(name, body.replace("{source}", source)) for name, body in DRAWS]


FRACTIONS = [("fr", "SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS fraction")]
NESTED = [
    (
        "nested",
        """SELECT f.fraction, l.* FROM {source} l JOIN draws d USING (cohort, sample_id)
        JOIN fr f ON d.i <= greatest(2, CAST(round_even(f.fraction * d.n, 0) AS BIGINT))""",
    )
]


def _nested(source):
    return [(name, body.replace("{source}", source)) for name, body in NESTED]


_PER_CLASS = [
    (
        "cls",
        """SELECT label, count(*) AS support,
          count(*) FILTER (prediction = label) AS hit FROM pred GROUP BY label""",
    ),
    ("said", "SELECT prediction AS label, count(*) AS predicted FROM pred GROUP BY prediction"),
    (
        "pc",
        """SELECT cls.label, support, coalesce(hit / predicted, 0) AS precision, hit / support AS recall
        FROM cls LEFT JOIN said ON said.label = cls.label""",
    ),
]

_SUBSAMPLE_TEST = [
    (name, body)
    for name, body in (
        [
            (
                "contrasted",
                "SELECT CAST(fraction AS VARCHAR) AS cohort, grp, feature_id, sample_id, cnt "
                "FROM nested",
            )
        ]
        + _norm("contrasted")
        + EXPRESSED
        + MOMENTS
        + WELCH
    )
]

ORACLES = {
    "src_matrix_text": _query(
        EVENTS,
        """SELECT 'row' AS kind, feature_id || chr(9) || string_agg(CAST(cnt AS VARCHAR), chr(9) ORDER BY pos)
          AS value FROM mat GROUP BY feature_id, pos // 1024
        UNION ALL
        SELECT 'header', 'gene_id' || chr(9) || string_agg(sample_id, chr(9) ORDER BY pos)
        FROM users GROUP BY pos // 1024""",
    ),
    "src_matrix_header": _query(EVENTS, "SELECT pos % 1024 AS pos, sample_id FROM users"),
    "src_labels_tsv": _query(EVENT_LABELS, "SELECT sample_id, sample_type FROM lab"),
    "matrix_to_long": _query(EVENTS, "SELECT feature_id, sample_id, cnt AS count FROM mat"),
    "label_filter": _query(
        EVENTS + EVENT_LABELS,
        """SELECT feature_id, sample_id, cnt AS count, sample_type FROM mat JOIN lab USING (sample_id)
        WHERE sample_type IN ('Primary Tumor', 'Solid Tissue Normal')""",
    ),
    "label_distribution": _query(
        BY_LANG,
        'SELECT cohort, grp AS "group", count(DISTINCT sample_id) AS n_samples FROM lng GROUP BY ALL',
    ),
    "sink_long_roundtrip": _query(
        RETAIL_BY_REGION,
        'SELECT cohort, grp AS "group", feature_id, sample_id, cnt AS count FROM lng',
    ),
    "sink_csv_roundtrip": _query(
        CORPUS + TEST,
        f"SELECT cohort, feature_id, {_r('log2fc', 'log2fc')}, {_r('t_stat', 't_stat')}, "
        "n_case, n_control FROM tested",
    ),
    "audit_long": _query(
        BY_LANG,
        """SELECT cohort, count(*) AS n_rows, count(DISTINCT feature_id) AS n_features,
          count(DISTINCT sample_id) AS n_samples FROM lng GROUP BY cohort""",
    ),
    "feature_bucket": _query(
        CORPUS,
        """SELECT feature_id, CAST('0x' || substr(md5(feature_id), 1, 8) AS BIGINT) % 16 AS bucket
        FROM (SELECT DISTINCT feature_id FROM lng)""",
    ),
    "library_size": _query(
        CORPUS,
        "SELECT cohort, sample_id, CAST(sum(cnt) AS BIGINT) AS lib_size FROM lng GROUP BY ALL",
    ),
    "log_cpm": _query(
        CORPUS + _norm("lng"),
        f"SELECT feature_id, sample_id, CAST(lib AS BIGINT) AS lib_size, {_r('cpm', 'cpm')}, "
        f"{_r('y', 'logcpm')} FROM norm",
    ),
    "expressed_features": _query(
        BY_LANG + PARTS + _norm("contrasted") + EXPRESSED,
        "SELECT cohort, feature_id, n_expressed, need AS min_samples FROM expressed",
    ),
    "densify": _query(
        RETAIL_BY_REGION,
        f'SELECT cohort, grp AS "group", feature_id, sample_id, cnt AS count FROM ({_dense("lng")})',
    ),
    "group_moments": _query(
        RETAIL_BY_REGION + PARTS + _norm("contrasted") + EXPRESSED + MOMENTS,
        "SELECT cohort, feature_id, n_case, n_control, "
        + ", ".join(_r(n, n) for n in ("mean_case", "mean_control", "var_case", "var_control"))
        + " FROM mom",
    ),
    "welch_t": _query(
        CORPUS + TEST,
        "SELECT feature_id, " + ", ".join(_r(n, n) for n in ("log2fc", "t_stat", "df")) + " FROM tested",
    ),
    "t_pvalue": _query(
        RETAIL_BY_REGION + TEST + PVALUE,
        "SELECT cohort, feature_id, "
        + ", ".join(_r(n, n) for n in ("t_stat", "df", "pvalue"))
        + " FROM pv",
    ),
    "bh_fdr": _query(
        [
            (
                "pv",
                """SELECT l_returnflag AS cohort, l_orderkey || '-' || l_linenumber AS feature_id,
                  l_discount / 0.1::DOUBLE AS pvalue FROM lineitem""",
            )
        ]
        + FDR,
        f"SELECT cohort, feature_id, {_r('pvalue', 'pvalue')}, {_r('fdr', 'fdr')}, rnk AS rank FROM de",
    ),
    "diff_analysis": _query(CORPUS + DE, f"SELECT {_DE_COLUMNS} FROM de"),
    "diff_by_cohort": _query(BY_LANG + DE, f"SELECT {_DE_COLUMNS} FROM de"),
    "de_summary": _query(
        BY_LANG + DE,
        """SELECT cohort, count(*) AS n_tested, count(*) FILTER (fdr < 0.05) AS n_significant,
          count(*) FILTER (fdr < 0.05 AND log2fc >= 1) AS n_up,
          count(*) FILTER (fdr < 0.05 AND log2fc <= -1) AS n_down FROM de GROUP BY cohort""",
    ),
    "de_top_p": _query(BY_LANG + DE, _top("de", "true", "rnk", 20, _REPORT)),
    "de_top_up": _query(
        BY_LANG + DE, _top("de", "fdr < 0.05", "round(log2fc, 9) DESC, feature_id", 10, _REPORT)
    ),
    "de_top_down": _query(
        BY_LANG + DE, _top("de", "fdr < 0.05", "round(log2fc, 9), feature_id", 10, _REPORT)
    ),
    "baseline_profile": _query(
        BY_LANG + BASELINE,
        f"SELECT cohort, feature_id, {_r('baseline_mean_logcpm', 'baseline_mean_logcpm')}, "
        f"{_r('baseline_median_logcpm', 'baseline_median_logcpm')} FROM base",
    ),
    "effect_baseline_join": _query(
        BY_LANG + TEST + BASELINE,
        f"SELECT cohort, feature_id, {_r('log2fc', 'log2fc')}, "
        f"{_r('baseline_mean_logcpm', 'baseline_mean_logcpm')}, "
        f"{_r('baseline_median_logcpm', 'baseline_median_logcpm')} "
        "FROM tested JOIN base USING (cohort, feature_id)",
    ),
    "attach_symbol": """SELECT CAST(c_nationkey AS VARCHAR) AS feature_id, c_custkey,
      CASE WHEN n_regionkey % 2 = 0 THEN n_name ELSE CAST(c_nationkey AS VARCHAR) END AS symbol
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "zscore": f"""SELECT c_mktsegment AS cohort, c_custkey, {_r('c_acctbal', 'c_acctbal')},
      {_r('(c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w', 'z_acctbal')}
      FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""",
    "target_score": _query(
        TARGET,
        "SELECT cohort, feature_id, symbol, "
        + ", ".join(
            _r(n, n)
            for n in (
                "log2fc",
                "fdr",
                "baseline_mean_logcpm",
                "baseline_median_logcpm",
                "z_effect",
                "z_baseline",
                "target_score",
            )
        )
        + " FROM scores",
    ),
    "volcano_points": _query(
        VOLCANO,
        f"SELECT cohort, feature_id, symbol, {_r('log2fc', 'log2fc')}, {_r('fdr', 'fdr')}, "
        f"{_r('neglog10p', 'neglog10p', 3)}, side FROM points",
    ),
    "volcano_labels": _query(
        VOLCANO
        + [
            (
                "picks",
                """SELECT *,
                  row_number() OVER (PARTITION BY cohort, side
                    ORDER BY round(neglog10p * abs(log2fc), 3) DESC, feature_id) AS by_score,
                  row_number() OVER (PARTITION BY cohort, side
                    ORDER BY round(abs(log2fc), 9) DESC, feature_id) AS by_effect
                FROM points WHERE side <> 'none'""",
            )
        ],
        "SELECT cohort, feature_id, symbol, side FROM picks WHERE by_score <= 8 OR by_effect <= 4",
    ),
    "quadrant": _query(
        TARGET,
        "SELECT cohort, feature_id, "
        + ", ".join(_r(n, n) for n in ("log2fc", "fdr", "baseline_mean_logcpm", "safe_max"))
        + ", zone FROM judged",
    ),
    "quadrant_labels": _query(
        TARGET,
        "\nUNION ALL\n".join(
            _top(
                "judged",
                f"zone = '{zone}'",
                order,
                k,
                f"cohort, feature_id, symbol, zone, {_r('log2fc', 'log2fc')}, "
                f"{_r('baseline_mean_logcpm', 'baseline_mean_logcpm')}",
            )
            for zone, order, k in (
                ("good", "round(log2fc, 9) DESC, feature_id", 12),
                ("danger", "round(baseline_mean_logcpm, 9) DESC, feature_id", 6),
            )
        ),
    ),
    "verdict": _query(
        TARGET,
        f"SELECT cohort, feature_id, symbol, {_r('target_score', 'target_score')}, verdict FROM judged",
    ),
    "top_candidates": _query(
        TARGET, _top("judged", "fdr < 0.05", "round(target_score, 9) DESC, feature_id", 20, _TARGETS)
    ),
    "top_danger": _query(
        TARGET,
        _top(
            "judged",
            "fdr < 0.05 AND log2fc > 1",
            "round(baseline_mean_logcpm, 9) DESC, feature_id",
            10,
            _TARGETS,
        ),
    ),
    "recurrence": _query(
        RECURRENCE,
        f"""SELECT feature_id, symbol, count(DISTINCT cohort) AS n_cohorts,
          {_r('avg(target_score)', 'mean_score')}, {_r('avg(log2fc)', 'mean_log2fc')},
          row_number() OVER (ORDER BY count(DISTINCT cohort) DESC, round(avg(target_score), 9) DESC,
            feature_id, symbol) AS rank
        FROM scores WHERE fdr < 0.05 AND log2fc > 1 AND baseline_mean_logcpm <= 14 GROUP BY feature_id, symbol
        HAVING count(DISTINCT cohort) >= 2""",
    ),
    "serve_profiles": _query(
        TARGET,
        f"SELECT cohort, feature_id, symbol, {_r('log2fc', 'efficacy_log2fc')}, "
        f"{_r('fdr', 'efficacy_fdr')}, {_r('baseline_mean_logcpm', 'safety_baseline')}, "
        f"{_r('target_score', 'target_score')}, verdict FROM judged",
    ),
    "serve_lookup": _query(
        TARGET
        + [
            (
                "wanted",
                """SELECT DISTINCT w AS wanted FROM (
                  SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL
                  SELECT unnest(string_split_regex(text, '[^\\p{L}\\p{M}]+')) FROM benchmark)
                WHERE w <> ''""",
            )
        ],
        f"""SELECT wanted, feature_id IS NOT NULL AS found, cohort, feature_id, verdict,
          {_r('target_score', 'target_score')}, {_r('log2fc', 'log2fc')}, {_r('fdr', 'fdr')},
          {_r('baseline_mean_logcpm', 'baseline_mean_logcpm')}
        FROM wanted LEFT JOIN judged ON replace(upper(symbol), 'ẞ', 'SS') = replace(upper(wanted), 'ẞ', 'SS')""",
    ),
    "serve_top_candidates": _query(
        TARGET,
        _top(
            "judged",
            "verdict = 'candidate'",
            "round(target_score, 9) DESC, feature_id",
            10,
            f"cohort, symbol, {_r('target_score', 'target_score')}, {_r('log2fc', 'log2fc')}",
        ),
    ),
    "serve_top_danger": _query(
        TARGET,
        _top(
            "judged",
            "verdict = 'danger'",
            "round(baseline_mean_logcpm, 9) DESC, feature_id",
            5,
            f"cohort, symbol, {_r('target_score', 'target_score')}, "
            f"{_r('baseline_mean_logcpm', 'baseline_mean_logcpm')}",
        ),
    ),
    "serve_stats": _query(
        TARGET,
        """SELECT cohort, count(*) AS n_total, count(*) FILTER (verdict = 'candidate') AS n_candidate,
          count(*) FILTER (verdict = 'danger') AS n_danger,
          count(*) FILTER (verdict = 'not_significant') AS n_not_significant
        FROM judged GROUP BY cohort""",
    ),
    "union_cohorts": _query(
        _retail("r_name", BRAND_TYPE),
        """SELECT feature_id, sample_id, cnt AS count, cohort AS domain,
          CAST(grp = 'case' AS BIGINT) AS is_case,
          cohort || '-' || CASE grp WHEN 'case' THEN 'case' ELSE 'control' END AS group_label
        FROM lng WHERE grp <> 'other'""",
    ),
    "samples_per_group": _query(
        _retail("r_name", BRAND_TYPE),
        """SELECT cohort || '-' || CASE grp WHEN 'case' THEN 'case' ELSE 'control' END AS group_label,
          count(DISTINCT sample_id) AS n_samples FROM lng WHERE grp <> 'other' GROUP BY ALL""",
    ),
    "strip_version_collapse": _query(
        COLLAPSED, f'SELECT feature_id, sample_id, grp AS "group", {_r("logcpm", "logcpm")} FROM merged WHERE logcpm <> 0'
    ),
    "top_variable": _query(
        COLLAPSED,
        f"""SELECT feature_id, {_r('v', 'variance')}, i - 1 AS pos
        FROM (SELECT feature_id, v, row_number() OVER (ORDER BY v DESC, feature_id) AS i
              FROM (SELECT feature_id, var_samp(logcpm) AS v FROM merged GROUP BY feature_id))
        WHERE i <= 10""",
    ),
    "pivot_matrix": "SELECT CAST(user_id AS VARCHAR) AS sample_id, "
    + ", ".join(
        f"count(*) FILTER (event_type = '{name}') AS {name}"
        for name in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events GROUP BY user_id",
    "wide_vectors": _query(
        VECTORS,
        f"""SELECT sample_id, count(*) AS n_features, {_r('sum(v)', 'total')},
          {_r('sum(v * (pos + 1))', 'weighted')} FROM vec GROUP BY sample_id""",
    ),
    "standardize_long": _query(
        VECTORS,
        f"""SELECT sample_id, CAST(pos AS VARCHAR) AS feature_id,
          {_r('(v - avg(v) OVER w) / stddev_samp(v) OVER w', 'z')}
        FROM vec WINDOW w AS (PARTITION BY pos)""",
    ),
    "svd_scores_norm": _query(
        VECTORS,
        f"""SELECT count(*) AS n_components, {_r('sum(n - 1)::DOUBLE', 'energy')}
        FROM (SELECT pos, count(*) AS n FROM vec GROUP BY pos HAVING var_samp(v) > 0)""",
    ),
    "svd_gramian": _query(
        VECTORS,
        f"""SELECT a.pos AS i, b.pos AS j, {_r('corr(a.v, b.v) * (count(*) - 1)', 'value')}
        FROM vec a JOIN vec b ON a.sample_id = b.sample_id GROUP BY a.pos, b.pos""",
    ),
    "svd_features": _query(
        VECTORS + _components(50),
        f"""SELECT sample_id, CAST(any_value(label) AS VARCHAR) AS domain, CAST(any_value(label) >= 5 AS BIGINT) AS is_case,
          {_flat(50)}
        FROM components JOIN (SELECT DISTINCT sample_id, label FROM vec) USING (sample_id) GROUP BY sample_id""",
        recursive=True,
    ),
    "projection": _query(
        VECTORS + _components(3),
        f"""SELECT sample_id, CAST(any_value(label) AS VARCHAR) AS domain, CAST(any_value(label) >= 5 AS BIGINT) AS is_case,
          {_r('max(u) FILTER (c = 0)', 'component_x')}, {_r('max(u) FILTER (c = 2)', 'component_y')}
        FROM components JOIN (SELECT DISTINCT sample_id, label FROM vec) USING (sample_id) GROUP BY sample_id""",
        recursive=True,
    ),
    "reduced_cohorts": _query(
        VARIABLE + _components(10),
        f"""SELECT sample_id, any_value(domain) AS domain, any_value(is_case) AS is_case,
          any_value(domain) || '-' || CASE any_value(is_case) WHEN 1 THEN 'case' ELSE 'control' END AS group_label,
          {_flat(10)}
        FROM components JOIN (SELECT DISTINCT sample_id, cohort AS domain, CAST(grp = 'case' AS BIGINT) AS is_case
                              FROM kept) USING (sample_id) GROUP BY sample_id""",
        recursive=True,
    ),
    "reduced_labels": _query(
        _retail("r_name", BRAND_TYPE),
        """SELECT DISTINCT sample_id, cohort AS domain, CAST(grp = 'case' AS BIGINT) AS is_case,
          cohort || '-' || CASE grp WHEN 'case' THEN 'case' ELSE 'control' END AS group_label
        FROM lng WHERE grp <> 'other'""",
    ),
    "rf_held_out": """SELECT sample_id, CAST(label >= 5 AS BIGINT) AS label, true AS sound
      FROM (SELECT CAST(vec_id AS VARCHAR) AS sample_id, label FROM embeddings)
      WHERE CAST('0x' || substr(md5('42:' || sample_id), 1, 8) AS BIGINT) % 10000 >= 7000""",
    "rf_importance_total": _query(
        VECTORS,
        "SELECT count(DISTINCT pos) AS n_features, 1.0::DOUBLE AS total, 0::BIGINT AS n_negative FROM vec",
    ),
    "svd_row_energy": _query(
        VECTORS,
        f"""SELECT sample_id, {_r('sum(z * z)', 'energy')} FROM (
          SELECT sample_id, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z
          FROM vec WINDOW w AS (PARTITION BY pos)) GROUP BY sample_id""",
    ),
    "train_test_split": """SELECT sample_id,
      CASE WHEN CAST('0x' || substr(md5('42:' || sample_id), 1, 8) AS BIGINT) % 10000 < 7000
        THEN 'train' ELSE 'test' END AS part
      FROM (SELECT CAST(vec_id AS VARCHAR) AS sample_id FROM embeddings)""",
    "classifier_metrics": _query(
        PREDICTIONS
        + _PER_CLASS
        + [
            (
                "pos",
                """SELECT label, avg(i) OVER (PARTITION BY score) AS mid FROM
                (SELECT label, score, row_number() OVER (ORDER BY score) AS i FROM pred)""",
            ),
            ("sizes", "SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM pred"),
        ],
        f"""SELECT 'accuracy' AS metric, {_r('avg(CAST(label = prediction AS INT))', 'value')} FROM pred
        UNION ALL SELECT 'f1', {_r('sum(support * CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END) / sum(support)', 'value')} FROM pc
        UNION ALL SELECT 'auc', {_r('(sum(mid) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n))', 'value')} FROM pos CROSS JOIN sizes""",
    ),
    "per_class_metrics": _query(
        PREDICTIONS + _PER_CLASS,
        f"SELECT CAST(label AS BIGINT) AS label, support, {_r('precision', 'precision')}, "
        f"{_r('recall', 'recall')} FROM pc",
    ),
    "confusion_matrix": _query(
        PREDICTIONS,
        """SELECT CAST(label AS BIGINT) AS label, count(*) FILTER (prediction = 0) AS predicted_0,
          count(*) FILTER (prediction = 1) AS predicted_1 FROM pred GROUP BY label""",
    ),
    "subsample_samples": _query(
        RETAIL_BY_REGION + _draws("lng"),
        """SELECT cohort, grp AS "group", feature_id, sample_id, cnt AS count
        FROM lng JOIN draws USING (cohort, sample_id)
        WHERE i <= greatest(2, CAST(round_even(0.25::DOUBLE * n, 0) AS BIGINT))""",
    ),
    "subsample_diff": _query(
        RETAIL
        + [("source", "SELECT * FROM lng WHERE grp IN ('case', 'control')")]
        + _draws("source")
        + FRACTIONS
        + _nested("source")
        + _SUBSAMPLE_TEST
        + [
            ("sized", "SELECT fraction, count(DISTINCT sample_id) AS n_samples, count(*) AS n_rows FROM nested GROUP BY fraction"),
            ("hits", "SELECT cohort, count(*) AS n_features_tested FROM tested GROUP BY cohort"),
        ],
        """SELECT 'all' AS cohort, fraction, n_samples, n_rows,
          coalesce(n_features_tested, 0) AS n_features_tested
        FROM sized LEFT JOIN hits ON hits.cohort = CAST(fraction AS VARCHAR)""",
    ),
    "scaling_fit": _query(
        RETAIL
        + _draws("lng")
        + FRACTIONS
        + _nested("lng")
        + [
            (
                "points",
                "SELECT count(*) / 1e6 AS x, sum(cnt) / 1000.0 AS seconds FROM nested GROUP BY fraction",
            ),
            (
                "line",
                """SELECT regr_slope(seconds, x) AS slope, regr_intercept(seconds, x) AS fixed,
                  count(*) AS n_points FROM points
                WHERE x >= (SELECT max(x) FROM (SELECT x FROM points ORDER BY x LIMIT 2))""",
            ),
        ],
        f"""SELECT {_r('slope', 'sec_per_million_rows')}, {_r('fixed', 'fixed_seconds')}, n_points,
          {_r('(slope * 47892 + fixed) / 3600', 'corpus_hours')} FROM line""",
    ),
}

# The same rows, wherever the two sides are stored.
ORACLES["stored_join"] = ORACLES["effect_baseline_join"]
