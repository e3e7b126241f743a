import re
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import same_look as sl
from corvane.llm import site_lines as ln
from corvane.session import table

SCHEMA = "fetch_id bigint, url string, source_url string, markdown string, site string, page string, line string"


def brute(rows):
    host = lambda u: re.sub(r"^www\.", "", (re.match(r"(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (u or "").strip().lower()) or ["", ""])[1])
    pages, on, where = defaultdict(set), defaultdict(set), defaultdict(list)
    for i, url, src, md, *_ in rows:
        if md is None:
            continue
        page = src or url
        pages[host(page)].add(page)
        for n, line in enumerate(md.split("\n")):
            k = "".join(c for c in line.lower() if c.isalpha())
            if len(k) >= 15:
                on[host(page), k].add(page)
                where[host(page), k].append((i, n))
    return {x for k, v in where.items() if len(on[k]) >= 5 and len(on[k]) >= 0.1 * len(pages[k[0]]) for x in v}


def test_repeated_lines_of_the_test_data(spark, data):
    d = table(spark, data.replace("0.001", "0.01"), "normalized_documents")
    want = brute([tuple(r) for r in d.select("fetch_id", "url", "source_url", "markdown").collect()])
    assert {tuple(r) for r in ln.found(d).collect()} == want and want


def test_variants_repeats_and_odd_rows(spark):
    legal = ["All rights reserved by Us 2024", "ALL RIGHTS RESERVED by us, 2025!", "> all rights reserved BY US"]
    rows = [(i, f"https://www.a.example:443/p{i}?x", None if i % 2 else "", f"Text of page number {'abcdefghij'[i]} here\n\n{legal[i % 3]}", "s", "p", "l") for i in range(6)]
    rows += [(10, "https://b.example/1", None, "\n".join(["One line that comes many times"] * 9), "", "", ""), (11, None, None, "All rights reserved by Us", "", "", ""), (12, "https://a.example/n", None, None, "", "", ""), (13, "https://a.example/e", "https://A.example/e", "", "", "", "")]
    rows += [(20 + i, "https://a.example/same", None, "A line of one page fetched often", "", "", "") for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in ln.found(df).collect()} == {(i, 2) for i in range(6)} == brute(rows)
    clean = {r.fetch_id: (r.markdown, r.removed) for r in ln.without_repeated_lines(df).collect()}
    assert clean[0] == ("Text of page number a here\n", 1) and clean[12] == (None, 0) and clean[13] == ("", 0) and len(clean) == len(rows)
    assert ln.found(spark.createDataFrame([], SCHEMA)).count() == 0 and ln.without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dense_containers_are_bit_strings(spark):
    """Above 2,048 places a container is a bit string with the same places."""
    want = {0: set(range(0, 30000, 3)), 1: {5, 32767}, 2: set(range(2049))}
    held = spark.createDataFrame([("s", 1, c, sorted(p)) for c, p in want.items()], "site string, k1 bigint, container bigint, places array<smallint>")
    got = ln.compressed(held).withColumn("n", ln.F.bitmap_count("bits")).withColumn("all", ln.places_of(ln.F.col("places"), ln.F.col("bits"))).collect()
    assert {r.container: set(r.all) for r in got} == want
    assert {r.container: r.n for r in got} == {0: 10000, 1: None, 2: 2049} and {r.container for r in got if r.places is None} == {0, 2}


@pytest.mark.parametrize("a, b", [("Ｈｅｌｌｏ１", "Hello1"), ("é", "é"), ("ﾊﾞｽ", "バス"), ("ガ", "ガ"), ("a​b­", "ab"), ("a b c　", "a b c "), ("раура", "paypa"), ("ο", "o"), ("ﬁn", "fin"), ("ё", "ë"), ("（x）", "(x)"), ("e‍́", "é"), ("ｱ️", "ア")])
def test_equal_looks(a, b):
    assert sl.one_form(a) == sl.one_form(b)


@pytest.mark.parametrize("a, b", [("e", "é"), ("A", "a"), ("x2", "x²"), ("ß", "ss"), ("か", "が"), ("и", "й"), ("l", "1"), ("O", "0"), ("a\nb", "a b"), ("n", "ñ"), ("œ", "oe"), ("П", "п")])
def test_different_looks(a, b):
    assert sl.one_form(a) != sl.one_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_a_form_is_its_own_form(text):
    f = sl.one_form(text)
    assert sl.one_form(f) == f
    assert sl.one_form(unicodedata.normalize("NFD", text)) == sl.one_form(unicodedata.normalize("NFC", text))


def test_table_is_checked(monkeypatch):
    assert len(sl.compile_table()) > 300
    monkeypatch.setattr(sl, "LOOK_ALIKES", (("А", "a"),))
    with pytest.raises(ValueError, match="case"):
        sl.compile_table()
    monkeypatch.setattr(sl, "LOOK_ALIKES", (("АВ", "ВB"),))
    assert sl.compile_table()["А"] == "B"  # a chain is followed to its end


def test_pairs(spark):
    rows = [(1, "Hello", "x"), (2, "Ｈello", "x"), (3, "Hello", "x"), (4, "hello", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (None, "Ｈello", "x"), (2, "Ｈello", "x"), (8, "é" * 50000, "x"), (9, "é" * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    assert {tuple(r) for r in sl.found(df).collect()} == {(1, 2), (2, 3), (6, 7), (8, 9)}
    assert sl.found(df.limit(0)).count() == 0
    forms = [r.form for r in sl.consistent(df).orderBy("id").collect()]
    assert forms[1:4] == ["Hello", "Hello", "Hello"] and None in forms


def test_large_groups_are_stars(spark):
    rows = [(i, ["Hello", "Ｈello", "Hellо"][i % 3]) for i in range(300)]
    got = [tuple(r) for r in sl.same_look(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    text = dict(rows)
    assert {x for p in got for x in p} == set(range(300)) and len(got) <= 300 and all(a < b and text[a] != text[b] for a, b in got)


def test_large_looks_give_every_pair_of_different_writings(spark, monkeypatch):
    monkeypatch.setattr(sl, "TILE", 16)
    written = ["".join(c if n >> k & 1 else d for k, (c, d) in enumerate(zip("\u043e\u0435\u0430\u0441\u0440\u0445\u0443\u043e", "oeacpxyo"))) for n in range(256)]
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(written))][:90]
    rows += [(100 + i, "Ｂоok") for i in range(63)] + [(200, "Book"), (201, "Bооk")] + [(300 + i, "Next") for i in range(70)] + [(400, "Nехt"), (401, "Ｎext")]
    got = {tuple(r) for r in sl.same_look(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and x != y and sl.one_form(x) == sl.one_form(y)} and len(got) > 2080


def test_members_tell_the_pairs_of_copies(spark):
    rows = [(i, ["Hello", "Ｈello", "Hellо"][i % 3]) for i in range(300)] + [(900, "alone"), (901, "alone")]
    got = {tuple(r) for r in sl.members(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(i, i % 3, 0) for i in range(300)}


@pytest.mark.parametrize("text", ["Привет, как дела? Москва", "Ελληνικά και άλλα", "він їхав", "Ёжик в тумане", "plain Latin naïve"])
def test_words_of_one_script_stay_in_it(text):
    assert sl.one_form(text) == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize("a, b, form", [("Mocква", "Москва", "Москва"), ("рaуpа", "paypa", "paypa"), ("Ёлка", "Ëлкa", "Ёлка"), ("ﾊﾞｽ", "ﾊﾞｽ", "バス")])
def test_look_alikes_take_the_script_of_their_word(a, b, form):
    assert sl.one_form(a) == sl.one_form(b) == form == sl.one_form(form)


def test_entries_of_several_characters():
    t = sl.compile_table()
    assert t["e\u0301"] == "é" and t["ﾊﾞ"] == "バ" and t["а\u0308"] == "ä" and max(map(len, t)) == 3
