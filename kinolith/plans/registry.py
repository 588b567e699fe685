"""All queries of the core with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("problems", "corpus", "series", "scenes", "vectors", "streams", "exports", "scripts")

#: Counts that the engine gives in 32 bits; their twins are cast to the same type.
NARROW = {
    "clean_text": ["clean_len"], "union_labelled": ["n_chars"], "tokenise": ["n"], "num_tokens": ["n_numbers"], "regex_tags": ["n"],
    "coalesce_first_nonblank": ["n_chars"], "shot_sessions": ["first_pos", "end_pos"], "decimate_every_k": ["pos"],
    "dsl_parse": ["n_cast", "n_props", "n_events"], "scan_vectors": ["n"], "parse_kv_lines": ["line_no", "n_words"],
    "parse_lines_dispatch": ["line_no", "seq"], "frame_replay": ["line_no", "seq"],
}

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"kinolith.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
for _name, _columns in NARROW.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _columns)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
