import pytest
from conftest import DATA, needs_data
from factloom.llm import files, pieces, prose
from pyspark.sql import functions as F

PY = '''"""Dieses Modul liest die Datei nur einmal ein."""
# eslint-disable-next-line no-console
# The cache must be read before the loader starts.

x = "SELECT a, b FROM t WHERE a > 3"  # Si le filtre est absent, on utilise la liste.
y = 'https://a.example/b'; z = f"Если буфер не найден, используется ветка. {x}"
w = "\\u3053\\u306e\\u30d0\\u30c3\\u30d5\\u30a1\\u306f\\u4e00\\u5ea6\\u3060\\u3051\\u8aad\\u307f\\u307e\\u3059\\u3002"
# value = compute(3)
# ---------------------
# SPDX-License-Identifier: MIT
#
# El registro se lee una sola
# vez porque no cambia.
def f():
    """缓冲区必须等待队列处理完成之后才能释放。"""
'''
WANT = {(1, "de"), (2, "en"), (5, "fr"), (6, "ru"), (7, "ja"), (8, "es"), (15, "zh")}


def test_pieces_of_python():
    got = {(line, prose.language_of(t)) for line, _, t, _ in pieces.pieces_of(PY, "python")}
    assert {g for g in got if g[1]} == WANT


@pytest.mark.parametrize("language,text,want", [
    ("javascript", "/**\n * The report lists all findings of the scan.\n */\nlet a = `It would be nicer to ${x} split it.`; // if (a) { b(); }\n/* istanbul ignore next */", {(1, "en"), (4, "en")}),
    ("rust", "/// Each span carries a key of its own.\n/// So it is.\nfn f<'a>(x: &'a str) { g('\"', r#\"We read the \"file\" only once per run.\"#); }\n/* ein /* inneres */ Wort ist noch nicht alles */", {(1, "en"), (3, "en"), (4, "de")}),
    ("cpp", "#include \"a/b of the c.h\"\nint x; // The loader is not ready yet.\n// Nor is it here, as we know.\nauto s = R\"x(If the plan and the scan disagree, trust it.)x\";", {(2, "en"), (3, "en"), (4, "en")}),
])
def test_pieces_of_others(language, text, want):
    got = {(line, prose.language_of(t)) for line, _, t, _ in pieces.pieces_of(text, language)}
    assert {g for g in got if g[1]} == want


@pytest.mark.parametrize("text", ["", "   ", "todo", "one two three", "a_b = c_d(4)", "if a_b is None: return c_d", "--flag=3", "key.name_ms", "(a|b)[a-z]+(", "%s/a/%d.b", "noqa: E501", "type: ignore[attr-defined]", "fmt: off", "clang-format off", "SELECT a, b FROM c WHERE a > 3 ORDER BY b", "-" * 60, "x" * 50_000, "https://a.b/c?d=e", "キャッシュ", "# sourceMappingURL=a.js.map", "aJOip4Dd5UMbf+pqtlnhpnO5l4FVgdX2nPb7B0MQ"])
def test_no_prose(text):
    assert prose.language_of(text) is None


@pytest.mark.parametrize("text,language", [
    ("Code generated by stubsmith 2.3. DO NOT EDIT.", "en"), ("@generated by schemapress from a.b", "en"), ("TODO: Without a key the cache is empty.", "en"), ("NOTE(ops): 该模块只读取一次，因为边界在扫描过程中不会改变。", "zh"), ("Most users never see the plan. {value}", "en"),
    ("Automatisch erzeugt aus x.y, bitte nicht von Hand bearbeiten.", "de"), ("Fichier produit automatiquement par a-gen, ne pas modifier à la main.", "fr"), ("Cuidado: el módulo fijo siempre espera a que termine la salida.", "es"), ("the " * 40_000, "en"),
])
def test_prose(text, language):
    assert prose.language_of(text) == language


@pytest.mark.parametrize("source,want", [('"a\\n\\x41\\u00e9\\U0001F600\\101"', "a\nAé😀A"), ("r'a\\n'", "a\\n"), ('"\\ud83d\\ude00"', "😀"), ("'-' * 8", "-"), ('R"(a\\n)"', "a\\n"), ('r#"a"b"#', 'a"b'), ("`a`", "a"), ('"open', "open"), ("", ""), ('"\\u{1F600}"', "😀"), ("b'x'", "x")])
def test_literals(source, want):
    assert pieces.literal(source) == want


def test_operator(spark):
    source = spark.createDataFrame([(1, "a.py", PY), (1, "a.py", PY), (2, "b.py", "x = = 1 # The loader is not ready yet."), (3, "c.py", None), (4, None, "# The loader is not ready yet."), (5, "d.py", ""), (6, "e.js", "// " + "the word " * 30_000)], "file_id long, path string, text string").withColumn("hash", F.lit("clash")).withColumn("bytes", F.lit(1))
    groups = spark.createDataFrame([(1, "The loader is not ready yet.", None, 4, None), (1, "The loader is not ready yet.", None, 4, None), (2, None, "'Bitte nicht von Hand ändern, es ist fest.'", None, "literal"), (3, None, None, 5, "line"), (4, "noqa: E501", None, 7, None)], "group_id long, body string, expression string, start_line long, kind string")
    found = files.prose_spans(source, groups)
    got = {(r.origin, r.ref_id, r.start_line, r.nl_lang) for r in found.collect()}
    assert got == {("source_file", 1, a, b) for a, b in WANT} | {("source_file", 6, 1, "en"), ("comment_group", 1, 4, "en"), ("comment_group", 2, None, "de")}
    shares = {r.nl_lang: r.share for r in files.language_shares(found, source).where("file_id = 1").collect()}
    assert set(shares) == {b for _, b in WANT} and 0 < sum(shares.values()) < 1
    assert files.prose_spans(source.limit(0), groups.limit(0)).count() == 0


def test_equal_pieces_of_one_line_all_count(spark):
    one, two = '"The loader is not ready yet."', '"The reader is not ready yet."'
    source = spark.createDataFrame([(1, "a.js", f"x = [{one}, {two}, {one}];")] * 2, "file_id long, path string, text string")
    groups = spark.createDataFrame([], "group_id long, body string, expression string, start_line long")
    got = files.language_shares(files.prose_spans(source, groups), source).collect()
    assert [(r.nl_lang, r.pieces, r.prose_bytes) for r in got] == [("en", 3, 3 * len(one))]


def test_bytes_are_utf8(spark):
    comment = "# Если буфер не найден, используется эта ветка."
    source = spark.createDataFrame([(1, "a.py", "x = 1\r\n" + comment + "\r\n")], "file_id long, path string, text string")
    groups = spark.createDataFrame([], "group_id long, body string, expression string, start_line long")
    got = files.language_shares(files.prose_spans(source, groups), source).collect()
    assert [(r.nl_lang, r.prose_bytes, r.file_bytes) for r in got] == [("ru", len(comment.encode()), len(comment.encode()) + 7)]


def test_pieces_of_the_latest_text_only(spark):
    from datetime import datetime

    rows = [(1, "a.py", "# The old loader is not ready yet.\n", datetime(2024, 1, 1)), (1, "a.py", "\n# The new loader is ready by now.\n", datetime(2024, 2, 1)), (2, "b.py", "# It is the only text of the file.\n", None)]
    source = spark.createDataFrame(rows, "file_id long, path string, text string, observed_at timestamp")
    groups = spark.createDataFrame([], "group_id long, body string, expression string, start_line long")
    assert {(r.ref_id, r.start_line) for r in files.prose_spans(source, groups).collect()} == {(1, 2), (2, 1)}


@needs_data
def test_held_out_accuracy(spark):
    """Trained on the documents with even ids, the models name the language of the others; about two labels in a hundred are wrong themselves."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    model = files.language_model(documents.where("doc_id % 2 = 0"))
    rows = [(r.lang.strip().lower().split("-")[0], r.text) for r in documents.where("doc_id % 2 = 1 AND lang IS NOT NULL").collect()]
    rows = [(a, model.best(prose.words_of(t))) for a, t in rows if a in model.languages]
    assert len(rows) > 30 and sum(a == b for a, b in rows) >= 0.97 * len(rows)
    for text in ("Returns cached widget handle quickly", "Compute running checksum lazily"):
        assert prose.language_of(text, model) == "en"
    for text in ("kgx vrt plq mnz qqr", "if quota is None: return size"):
        assert prose.language_of(text, model) is None
