"""Relations of the engine. Every stored table carries the format version; another version is not read."""

FORMAT_VERSION = 1

FILES = "file string, pack string, role string, source_kind string, source_hash string, fingerprint string, parse_errors int, n_lines int, n_bytes long"
SYMBOL = (
    "id string, file string, ord int, kind string, raw string, start_line int, end_line int, signature string, docstring string, "
    "is_exported boolean, source_hash string, interface_hash string, markers array<string>, parent string, is_top_level boolean, public boolean"
)
IMPORT = "from_file string, ord int, specifier string, imported_name string, local_name string, form string"
FLOW = "from_file string, ord int, kind string, raw string"
