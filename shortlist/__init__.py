"""shortlist: a Spark-native product-recommendation analytics engine.

Every operator is a pure ``DataFrame -> DataFrame`` (or ``Column``) function
built from Spark SQL built-ins; there are no Python UDFs.
"""

from shortlist.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
