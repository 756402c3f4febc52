"""Row-wise vector expressions on ``array<double>`` columns.

All of these are built-in higher-order functions, so they stay in the JVM.
They are used for row-wise work (one vector against one other vector on the
same row).  Work over many pairs goes to the pair kernel instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Methods of the corpus score (Q3/Q4).
CORPUS_METHODS = ("cosine", "euclidean", "manhattan", "faiss_cosine", "faiss_l2")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col) -> Column:
    """Cast a vector column to ``array<double>`` before any arithmetic."""
    return _c(col).cast("array<double>")


def as_float(col) -> Column:
    """Round a vector to float32 (parity mode only)."""
    return _c(col).cast("array<float>").cast("array<double>")


def vsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Dot product."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_norm(a) -> Column:
    return vsum(F.transform(_c(a), lambda x: x * x))


def norm(a) -> Column:
    """L2 norm."""
    return F.sqrt(sq_norm(a))


def normalize(a) -> Column:
    """Unit vector; a zero vector stays zero."""
    # the norm is bound once; inside the inner lambda it would be summed anew for each element
    return F.transform(F.array(norm(a)), lambda n: F.when(n == 0, _c(a)).otherwise(
        F.transform(_c(a), lambda x: x / n)))[0]


def cosine_distance_raw(a, b) -> Column:
    """``1 - a.b / (|a| |b|)``, not clipped; NULL when a norm is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a, b) -> Column:
    """P5: library cosine distance: zero vector has similarity 0, result
    clipped to [0, 2]."""
    sim = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.lit(1.0) - sim))


def euclidean_distance(a, b) -> Column:
    """P6."""
    return F.sqrt(sq_euclidean_distance(a, b))


def sq_euclidean_distance(a, b) -> Column:
    """Squared L2 distance."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def manhattan_distance(a, b) -> Column:
    """P7."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def ip_distance(a, b) -> Column:
    """``1 - <a/|a|, b/|b|>``; zero vectors stay zero, so distance 1."""
    return F.lit(1.0) - dot(normalize(a), normalize(b))


def distance(method: str, a, b) -> Column:
    if method == "cosine":
        return cosine_distance(a, b)
    if method == "euclidean":
        return euclidean_distance(a, b)
    if method == "manhattan":
        return manhattan_distance(a, b)
    if method == "faiss_cosine":
        return ip_distance(a, b)
    if method == "faiss_l2":
        return sq_euclidean_distance(a, b)
    if method == "cosine_raw":
        return cosine_distance_raw(a, b)
    raise ValueError(f"Unknown method: {method}")


def normalize_score(method: str, score, dim) -> Column:
    """P10: per-method bound and cap at 1."""
    s = _c(score)
    d = _c(dim).cast("double")
    if method in ("cosine", "faiss_cosine"):
        return F.least(s, F.lit(1.0))
    if method in ("euclidean", "faiss_l2"):
        return F.least(s / (F.lit(2.0) * F.sqrt(d)), F.lit(1.0))
    if method == "manhattan":
        return F.least(s / (F.lit(2.0) * d), F.lit(1.0))
    raise ValueError(f"Unknown method: {method}")


def dim(a) -> Column:
    """P19."""
    return F.size(_c(a))


def invert(score) -> Column:
    """P12."""
    return F.lit(1.0) - _c(score)


def agreement_band(score) -> Column:
    """> 0.8 high, > 0.6 medium, else low."""
    s = _c(score)
    return (F.when(s > 0.8, F.lit("high"))
            .when(s > 0.6, F.lit("medium"))
            .otherwise(F.lit("low")))


def shorten(text, n: int = 30, always: bool = False) -> Column:
    """First ``n`` characters plus ``...`` (only when longer, unless
    ``always``)."""
    t = _c(text)
    cut = F.concat(F.substring(t, 1, n), F.lit("..."))
    if always:
        return cut
    return F.when(F.length(t) > n, cut).otherwise(t)


def pair_name(m1, m2) -> Column:
    """``"{m1}_vs_{m2}"``."""
    return F.concat(_c(m1), F.lit("_vs_"), _c(m2))


def cluster_key(label) -> Column:
    """``"cluster_{label}"``."""
    return F.concat(F.lit("cluster_"), _c(label).cast("string"))


def posterior_entropy(p) -> Column:
    """P20: ``-sum(p * ln(p + 1e-10))`` over a probability array."""
    return -vsum(F.transform(_c(p), lambda x: x * F.log(x + F.lit(1e-10))))


def add_at(vec, pos, amount: float) -> Column:
    """Add ``amount`` to the zero-based element ``pos`` of a vector."""
    return F.transform(_c(vec), lambda x, i: F.when(i == _c(pos), x + F.lit(amount)).otherwise(x))
