"""Distributed QR and truncated SVD of a tall matrix, one array of doubles a row.

No Gramian is made, so the condition isn't squared, and no features x features object
exists anywhere beyond ``EXACT`` features.

* ``tall_r``: every task reduces its rows of ``A W`` to a small R factor, and factors are
  stacked and reduced again by a two-level tree (tall-skinny QR).
* ``transposed``: ``A^T (A W)``, as sums by feature block over the same kind of tree. It only
  gives new search directions; values and vectors come from R factors.
* ``truncated_svd``: up to ``EXACT`` features R itself is decomposed, in one pass. Beyond it a
  random sketch spans the range; every cycle adds ``DEPTH`` further blocks of the Krylov
  space, decomposes the matrix on all of them and keeps the best directions, until the
  subspace of the wanted ones moves by less than ``TOLERANCE``.

What the driver and a task hold is features x (``DEPTH`` + 1) x sketch columns at most.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

# Up to so many features the R factor is taken of the matrix itself.
EXACT = 256
# Sketch columns beyond the wanted ones.
OVERSAMPLE = 20
DEPTH = 3
TOLERANCE = 1e-8
CYCLES = 20
# Least singular value that counts, relative to the largest.
R_COND = 1e-12
# Branches of a tree, and features of a block of sums.
FAN = 32
BLOCK = 256
# Cells of a block of rows that a task works on at a time.
CELLS = 1 << 22
SEED = 42


class Scaled:
    """The matrix behind a settled column of arrays: ``(row - mean) * scale``."""

    def __init__(self, rows, column, mean, scale):
        self.rows = rows.select(column)
        self.mean = np.asarray(mean, float)
        self.scale = np.asarray(scale, float)
        self.n = len(self.mean)

    def each_task(self, run, schema):
        """``run(blocks)`` over the blocks of rows of every task."""
        mean, scale, n = self.mean, self.scale, self.n
        step = max(1, CELLS // max(n, 1))

        def task(batches):
            parts = (batch.slice(at, step).column(0) for batch in batches for at in range(0, batch.num_rows, step))
            yield from run((part.flatten().to_numpy(zero_copy_only=False).reshape(-1, n) - mean) * scale for part in parts)

        return self.rows.mapInArrow(task, schema)


def _r_of(parts):
    stacked = np.vstack(parts)
    return np.linalg.qr(stacked, mode="r")


def _tree(parts, combine):
    """One payload a key, merged over two levels."""

    def run(rows):
        shapes = zip(rows.column("payload").to_pylist(), rows.column("width").to_pylist(), strict=True)
        merged = combine([np.frombuffer(p).reshape(-1, w) for p, w in shapes])
        key, part = (rows.column(c)[0].as_py() for c in ("key", "part"))
        return pa.table(_payload(key, part, merged), schema=_ARROW)

    half = parts.withColumn("part", F.pmod("part", F.lit(FAN))).groupBy("key", "part").applyInArrow(run, _SCHEMA)
    return half.groupBy("key").applyInArrow(run, _SCHEMA)


_SCHEMA = "key int, part int, width int, payload binary"
_ARROW = pa.schema([("key", pa.int32()), ("part", pa.int32()), ("width", pa.int32()), ("payload", pa.binary())])


def _payload(key, part, matrix):
    matrix = np.ascontiguousarray(matrix)
    return {"key": [key], "part": [part], "width": [matrix.shape[1]], "payload": [matrix.tobytes()]}


def tall_r(matrix, directions=None):
    """R of the QR decomposition of ``A`` or ``A W``; fewer rows than columns if A has fewer."""

    def run(blocks):
        r = None
        for block in blocks:
            y = block if directions is None else block @ directions
            r = _r_of([y] if r is None else [r, y])
        if r is not None:
            yield pa.RecordBatch.from_pydict(_payload(0, TaskContext.get().partitionId(), r), schema=_ARROW)

    found = _tree(matrix.each_task(run, _SCHEMA), _r_of).first()
    width = matrix.n if directions is None else directions.shape[1]
    return np.zeros((0, width)) if found is None else np.frombuffer(found["payload"]).reshape(-1, width)


def transposed(matrix, directions):
    """``A^T (A W)`` for ``W`` of ``directions``."""

    def run(blocks):
        total = None
        for block in blocks:
            own = block.T @ (block @ directions)
            total = own if total is None else total + own
        if total is not None:
            part = TaskContext.get().partitionId()
            for key in range(0, len(total), BLOCK):
                yield pa.RecordBatch.from_pydict(_payload(key, part, total[key : key + BLOCK]), schema=_ARROW)

    rows = _tree(matrix.each_task(run, _SCHEMA), sum).orderBy("key").collect()
    width = directions.shape[1]
    return np.vstack([np.frombuffer(row["payload"]).reshape(-1, width) for row in rows])


def _rank(sigma):
    return int((sigma > R_COND * sigma[0]).sum()) if len(sigma) and sigma[0] > 0 else 0


def _ritz(matrix, basis):
    """Right directions within a basis, best first, and their singular values."""
    _, sigma, vt = np.linalg.svd(tall_r(matrix, basis), full_matrices=False)
    keep = _rank(sigma)
    return basis @ vt[:keep].T, sigma[:keep]


def _further(block, basis):
    """An orthonormal block beyond a basis, from what the basis lacks of ``block``.

    Columns that the basis already has leave rounding errors, which are as good as random
    directions once they are orthogonal to the basis: hence the repetition.
    """
    block = block[:, : len(basis) - basis.shape[1]]
    for _ in range(3):
        block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    return block


def truncated_svd(matrix, k):
    """Singular values and right singular vectors (features x k), largest first.

    Fewer come back if the matrix has no more. Every vector's component of largest
    absolute value is positive (of equal ones the first). A matrix without rows has none.
    """
    n = matrix.n
    if n <= EXACT:
        _, sigma, vt = np.linalg.svd(tall_r(matrix), full_matrices=False)
        keep = min(k, _rank(sigma))
        return sigma[:keep], _signed(vt[:keep].T)
    width = min(n, k + OVERSAMPLE)
    start = np.random.default_rng(SEED).normal(size=(n, width))
    directions, sigma = _ritz(matrix, np.linalg.qr(start)[0])
    for _ in range(CYCLES if len(sigma) else 0):
        basis = last = directions
        for _ in range(DEPTH):
            if basis.shape[1] >= n:
                break
            # The rounding of A^T A lies along the strongest directions, which the basis has.
            last = _further(transposed(matrix, last), basis)
            basis = np.hstack([basis, last])
        found, sigma = _ritz(matrix, basis)
        found, sigma = found[:, :width], sigma[:width]
        wanted, before = found[:, :k], directions[:, :k]
        moved = np.linalg.norm(wanted - before @ (before.T @ wanted), 2) if wanted.size else 0.0
        directions = found
        if moved < TOLERANCE and wanted.shape[1] == before.shape[1]:
            break
    return sigma[:k], _signed(directions[:, :k])


def _signed(vectors):
    if not vectors.size:
        return vectors
    # Rounded, so that the choice among equal ones doesn't depend on the last bits.
    at = np.abs(vectors).round(9).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
