"""Queries over whole tables against brute force, on texts that the SQL of their filtered twins leaves out."""

import hashlib
import re

from folium.plans import catalog

TEXTS = ['a|"b|c"|d\n"x\ny"|z', '"q""r"|s\r\nt', "one\r\ntwo\r\n", "﻿a\r\nb", "a|b|c\n", "", '"open|end\nno', 'mid"quote|x\ry', None, "plain"]
S = "[\\t\\n\\x0b\\f\\r    -     　﻿]"


def rows_of(text):
    """Character by character."""
    rows, row, field, i, start = [], [], "", 0, True
    while i < len(text):
        c = text[i]
        if start and c == '"':
            i += 1
            while i < len(text) and not (text[i] == '"' and text[i + 1 : i + 2] != '"'):
                i += 2 if text[i] == '"' else 1
                field += text[i - 1]
            start = False
        elif c in "|\r\n":
            row.append(field)
            field, start = "", True
            if c != "|":
                i += text[i : i + 2] == "\r\n"
                rows.append(row)
                row = []
        else:
            field, start = field + c, False
        i += 1
    row.append(field)
    return rows + ([row] if len(row) > 1 or row[0] else [])


def test_documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    some = {i: t for i, t in enumerate(TEXTS) if t is not None}
    got = {r.doc_id: (r.n_rows, r.n_cols) for r in catalog.queries()["csv_ragged_width_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(r := rows_of(t)), max(map(len, r), default=None)) for i, t in some.items()}
    got = {r.doc_id: r.source_md5 for r in catalog.queries()["txt_roundtrip_whole"](spark, str(tmp_path)).collect()}
    eol = lambda t: "\r\n" if re.match(r"[^\n]*\r\n", t) else "\n"
    assert got == {i: hashlib.md5(re.sub("\r\n|\r|\n", eol(t), t).encode()).hexdigest() for i, t in some.items()}


def test_turns(spark, tmp_path):
    texts = ["a\nb long text here", "Name :", "x\r\n:", "\n", "first line\nlast:", "plain words", None]
    made = [(i, t, x) for i, x in enumerate(texts) for t in range(3)]
    spark.createDataFrame(made, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for i, t, x in made:
        if x is not None:
            x = [x[:12] + " :", "  ", x][t]
            m = re.match(rf"([^\n\r  ]{{1,40}}?){S}*[:：]{S}*\Z", x)
            want[i, t] = (bool(re.fullmatch(f"{S}*", x) or re.search(rf"[:：]{S}*\Z", x)), re.sub(rf"^{S}+|{S}+\Z", "", m[1]) if m else "")
    assert {(r.conv_id, r.turn): (r.target, r.label) for r in catalog.queries()["fill_targets_whole"](spark, str(tmp_path)).collect()} == want
