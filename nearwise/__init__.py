"""nearwise: exact semantic retrieval over tables, written as Spark jobs."""

from nearwise.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
