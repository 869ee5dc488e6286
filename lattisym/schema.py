"""Row types of the code graph."""

IMPORT = "struct<module:string,names:array<string>,line:int,is_relative:boolean>"
SYMBOL = "struct<name:string,kind:string,line:int,end_line:int,signature:string,docstring:string,parent:string,children:array<string>,decorators:array<string>>"
EDGE = "struct<kind:string,source:string,target:string,line:int>"

#: One row per file as the extractors give it.
PARSED = f"file_path string, content_hash string, parse_error string, imports array<{IMPORT}>, symbols array<{SYMBOL}>, edges array<{EDGE}>"

NODES = (
    "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, signature string, "
    "docstring string, parent_name string, decorators array<string>, children array<string>, file_hash string"
)
EDGES = "kind string, source_qualified string, target_qualified string, raw_target string, file_path string, line int"
FILES = f"file_path string, content_hash string, parse_error string, imports array<{IMPORT}>"

SOURCES = "file_path string, source string"
POSTINGS = "token string, field string, position int, qualified_name string, file_path string"
PAIRS = "a string, b string, file_path string"

GRAMS = "gram string, field string, file_path string"
#: Stored edges carry the name that the target ends with.
STORED_EDGES = f"{EDGES}, callee string"
RESOLVED_IMPORTS = "file_path string, at int, module string, names array<string>, line int, is_relative boolean, last string, resolved string"

#: Version of the stored layout: 1 had whole tables, 2 buckets, postings and pairs, 3 has grams, imports, counts and numbered states.
VERSION = 3
