"""tessera - tabular analytics and machine learning on Spark DataFrames and Spark ML."""

from tessera.session import checkpoint_dir, get_session, scratch_path

__version__ = "0.1.0"
__all__ = ["checkpoint_dir", "get_session", "scratch_path", "__version__"]
