from docketlake.sources.bulk import DIALECTS, Dialect, file_headers, read_bulk, read_header
from docketlake.sources.files import file_manifest, read_json_records, unreadable_files
from docketlake.sources.lines import read_court_lines, split_court_lines
from docketlake.sources.records import stitch_records

__all__ = [
    "DIALECTS",
    "Dialect",
    "file_headers",
    "file_manifest",
    "read_bulk",
    "read_court_lines",
    "read_header",
    "read_json_records",
    "split_court_lines",
    "stitch_records",
    "unreadable_files",
]
