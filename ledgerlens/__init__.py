"""ledgerlens: retail order-line analytics on Spark.

Every operator takes a DataFrame and returns a DataFrame built from Spark
built-ins, so Catalyst prunes, pushes down and plans the work and the cluster
runs it. See README.md for the operator map.
"""

from ledgerlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
