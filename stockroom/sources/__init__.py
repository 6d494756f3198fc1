"""Sources and sinks: raw parquet, derived business tables, upload files."""

from stockroom.sources.derived import Tables  # noqa: F401
from stockroom.sources.files import allowed_file, read_upload, write_table  # noqa: F401
