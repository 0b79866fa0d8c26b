import pytest
from factloom.llm import files, origin
from pyspark.sql import functions as F

LIB = "\n".join(f"def tool_{k}(a_{k}, b):\n    return a_{k} + b * {k} + helper_{k}(b)" for k in range(60)) + "\n"
UP = origin.Upstream([LIB, "short one", None, ""])
WRITTEN = """import log

class Reader(Base):
    limit = 3

    def read(self, path, mode=None):
        if not path:
            raise ValueError("no path")
        with open(path) as handle:
            rows = [clean(x) for x in handle if x != "a"]
        while rows:
            emit(rows.pop(), mode)
        return len(path)

def main(items):
    for item in items.values():
        try:
            item.run()
        except KeyError:
            log.warning("missing %s", item)
    assert items, "none"
    return {"a": 1, "b": items}
"""
BODY = "\n".join(f"def work_{k}(a):\n    if a > {k}:\n        return run_{k}(a)\n    log('{k}')\n    return {k}" for k in range(9)) + "\n"
PACKED = ";".join(f"function f{k}(a,b){{return a?b+{k}:a({k})}}" for k in range(60)) + ";\n"


@pytest.mark.parametrize("path,text,want", [
    ("src/a.py", BODY, None), ("src/vendor_portal/a.py", BODY, None), ("src/generator/a.py", BODY, None), ("services/minify/a.js", "let a = 1;\n", None), ("src/a.py", "", None), (None, BODY, None), ("a.py", None, None),
    ("src/a.py", BODY + '\nBANNER = "# Code generated by stubsmith. DO NOT EDIT."\n', None), ("src/a.py", BODY + "# keep in step with the generated stubs under gen, which nobody should edit by hand\n" + BODY, None), ("src/a.py", "# do not edit the order of these calls\n" + BODY, None),
    ("src/a.py", "# Code generated by x 2. DO NOT EDIT.\n" + BODY, "generated"), ("src/a.py", BODY + "# @generated by y from z\n", "generated"), ("src/a.py", "# Automatisch erzeugt aus a.b, bitte nicht von Hand bearbeiten.\n" + BODY, "generated"), ("src/a.rs", "// Fichier produit automatiquement par x, ne pas modifier à la main.\nfn f() {}", "generated"),
    ("gen/a_pb2.py", "".join(f"def get_{k}(m):\n    return m.slots[{k}]\n\n" for k in range(30)), "generated"), ("gen/a_pb2.py", WRITTEN, None), ("src/yarn.lock", "x" * 10, "generated"),
    ("static/a.min.js", PACKED, "minified"), ("src/a.js", PACKED, "minified"), ("src/a.js", "/*! lib v1 */\n" + PACKED + "//# sourceMappingURL=a.js.map\n", "minified"), ("src/a.min.js", "let a = 1;\n" * 40, None),
    ("vendor/lib/a.py", BODY, "vendored"), ("node_modules/lib/a.js", PACKED, "vendored"), ("lib/a.py", LIB, "vendored"), ("lib/a.py", "# vendored-at: 12\r\n" + LIB.replace("\n", "\r\n").replace("helper_3(", "other_3("), "vendored"), ("lib/a.py", LIB[: len(LIB) // 2], None),
    ("src/a.py", "DATA = [\n" + ",\n".join(f"  0x{k:02x}, {k}.5, -3" for k in range(60)) + "\n]\n", "data"), ("src/a.cpp", "static const Cell X[] = {\n" + ",\n".join(f'  "k-{k}"' for k in range(90)) + ",\n};", "data"), ("src/a.rs", 'pub static X: &[Cell] = &[\n "' + "A" * 3000 + '",\n];', "data"), ("src/a.ts", "export const X = [\n" + "1, " * 300 + "\n];\n", "data"),
    ("src/a.ts", "export const NAMES = [" + '"a", ' * 40 + "];\nexport function f(a: string): string { return a; }\n" + "export function g(b: string): string {\n  return f(b);\n}\n" * 9, None), ("src/a.py", "x = 1\n", None), ("src/a.py", "y" * 100_000 + "\n", None),
])
def test_category(path, text, want):
    got = origin.category(path, text, UP)
    assert (got and got[0]) == want


def test_similarity_is_jaccard_on_five_words():
    words = LIB.split()
    own = origin._TOKEN.findall(LIB)
    mine = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
    changed = " ".join(w if k % 97 else f"new_{k}" for k, w in enumerate(words))
    other = origin._TOKEN.findall(changed)
    theirs = {tuple(other[k : k + 5]) for k in range(len(other) - 4)}
    assert UP.best(changed) == pytest.approx(len(mine & theirs) / len(mine | theirs)) and UP.best("") == 0.0 and UP.best("a b") == 0.0
    assert origin.Upstream([]).best(LIB) == 0.0


def test_repeated_unknown_shingles_count_once():
    rows = " ".join(f"w{k}" for k in range(100))
    index = origin.Upstream([rows])
    changed = rows + " new0 new1 new2 new3 new4" * 40

    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    a, b = shingles(rows), shingles(changed)
    assert abs(index.best(changed) - len(a & b) / len(a | b)) < 1e-9 and index.best(changed) > 0.8


def test_operator(spark):
    source = spark.createDataFrame([(1, "r", "lib/a.py", LIB, None), (1, "r", "lib/a.py", LIB, None), (2, "r", "src/b.py", BODY, 3), (3, "r", "c.py", None, 1), (4, "r", None, "", None), (5, "r", "static/a.min.js", PACKED, None)], "file_id long, repository string, path string, text string, byte_count long").withColumn("category", F.lit("clash")).withColumn("rule", F.lit("clash"))
    upstream = spark.createDataFrame([(LIB, "x"), (None, "y")], "text string, category string")
    found = files.unwritten_files(source, upstream)
    assert {(r.file_id, r.category) for r in found.collect()} == {(1, "vendored"), (5, "minified")}
    history = spark.createDataFrame([("r", "lib/a.py", 9), ("r", "lib/a.py", None)], "repository string, path string, line_count long")
    assert {(r.file_id, r.byte_count, r.line_count) for r in files.with_history(found, source, history).collect()} == {(1, len(LIB), 9), (5, len(PACKED), None)}
    assert files.unwritten_files(source.limit(0), upstream.limit(0)).count() == 0


def test_bound(spark, monkeypatch):
    monkeypatch.setattr(files, "UPSTREAM_BOUND", 10)
    frame = spark.createDataFrame([(1, "a.py", LIB)], "file_id long, path string, text string")
    with pytest.raises(ValueError):
        files.unwritten_files(frame, frame)


@pytest.mark.parametrize("path,mark", [("a/b.py", "#"), ("a/b.cpp", "//")])
def test_notice_after_a_long_licence(path, mark):
    licence = "".join(f"{mark} Licence line {k}.\n" for k in range(40))
    notice, code = f"{mark} Code generated by a tool.\n", "x = 1\n" if mark == "#" else "int x = 1;\n"
    assert origin.category(path, licence + notice + code * 3, UP) == ("generated", "notice")
    assert origin.category(path, licence + code + notice + code, UP) is None


@pytest.mark.parametrize("comment,want", [
    ("# This helper explains how files are autogenerated by our tool chain.", False), ("# This file is autogenerated.", True), ("# Warning: this file was automatically generated", True), ("# how files are auto-generated; do not edit them", True),
    ("# @generated", True), ("// このファイルは自動生成されました", True), ("# Diese Datei wurde automatisch erzeugt", True), ("# the table generated from the schema is read here", False),
])
def test_a_notice_speaks_of_the_file(comment, want):
    assert origin.has_notice(comment) == want


@pytest.mark.parametrize("path,text,want", [
    ("src/a.py", "import a\n\n# Automatically generated, do not edit.\n\ndef f():\n    return 1\n", "generated"), ("src/a.ts", 'import { a,\n b } from "./c";\n\n// AUTOGENERATED FILE\nexport const d = 1;\n', "generated"), ("src/a.js", "function f() {}\n// AUTOGENERATED FILE\nf();\n", None),
    ("a.min.js", "let a=1;", "minified"), ("src/a.py", "X = [" + ", ".join(map(str, range(100))) + "]\n", "data"), ("src/a.py", "X = [1, 2, 3]\n", None), ("src/a.rs", "fn f(){g(1);h(2)}" * 60, "minified"),
])
def test_headers_suffixes_and_small_literals(path, text, want):
    got = origin.category(path, text, UP)
    assert (got and got[0]) == want


def test_the_latest_text_counts(spark):
    from datetime import datetime

    rows = [(1, "a.js", PACKED, datetime(2024, 1, 1)), (1, "a.js", WRITTEN, datetime(2024, 2, 1)), (2, "b.js", WRITTEN, datetime(2024, 1, 1)), (2, "b.js", PACKED, datetime(2024, 2, 1))]
    source = spark.createDataFrame(rows, "file_id long, path string, text string, observed_at timestamp")
    assert {(r.file_id, r.category) for r in files.unwritten_files(source, spark.createDataFrame([], "text string")).collect()} == {(2, "minified")}
    python = source.withColumn("path", F.lit("a.py"))
    assert {r.file_id for r in files.parse_errors(python).where("error_line > 0").collect()} == {2}
