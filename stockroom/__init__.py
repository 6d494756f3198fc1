"""stockroom — supply-management analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; the work is planned by
Catalyst and executed by Spark.  See ``README.md`` for the operator map.
"""

from stockroom.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
