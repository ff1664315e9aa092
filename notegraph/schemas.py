"""The tables operators pass to each other."""

FILES = "path string, mtime_ns bigint, size bigint, escaped boolean, content binary"
NODES = "id string, path string, kind string, title string, stem string, properties_json string, properties_text string, tags array<string>, headings array<string>, source_hash string, body string"
PROP = "name string, json_type string, value_json string, value_loose string, value_text string"
LINKS = "id string, pos int, raw string, syntax string, clean_target string, relative_target string, foreign boolean"
EDGES = "source string, relation string, target string, provenance string, source_location string, resolved boolean, position int"
ISSUES = "level string, code string, message string, path string"
POSTINGS = "term string, path string, zone int, count int"
