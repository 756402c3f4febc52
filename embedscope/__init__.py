"""embedscope: label-free hallucination scoring of embedding tables on Spark.

Every operator takes and returns DataFrames.  Vector columns are
``array<double>``; keys are explicit ``bigint`` columns.  Work that grows
with the number of vector pairs runs in the tiled pair kernel
(:mod:`embedscope.operators.pairs`); everything else is plain DataFrame /
SQL so Catalyst can prune, push down and pick join strategies.
"""

from embedscope.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
