import re

import pytest

from corvane.llm import residue as r
from corvane.llm import residue_seeds as seeds_
from corvane.session import table


@pytest.fixture(scope="module")
def models(spark, data):
    docs = table(spark, data.replace("0.001", "0.01"), "normalized_documents")
    return r.fit_models(r.prepared(docs, lines=r.lines_of_sites(docs)), docs.count())


REAL = "The index stores one row for every page and keeps the newest fetch of it. A reader that asks for an older one gets nothing, because the store moves its pointer only after all tables are written."


@pytest.mark.parametrize("text", ["# Guide\n\nSet {{ user.name }} first.", "Dear [Your Name], " + REAL, "Use ${serviceName} here", "%CONTAINER_NAME% is", "x @@SENSOR@@ y", "__IMAGE_VERSION__ z", "{% block feed %}", "#{locale} is", "starts, it {1} samples"])
def test_placeholders(models, text):
    assert r.is_residue(r.residue_of([text], models)[0])


@pytest.mark.parametrize("text", ["It links the button to $(shelf.title) of the list", "$(user_name) signed in", "The method [insert name here] links both", "the cursor [TITLE OF SHELF] copies it", "Dear [YOUR NAME], welcome", "as [your company] wishes", "see [add a link here] for more", "the ((SHELF GOES HERE)) copies it", "A ((shelf goes here)) stands", "the [shelf goes here] copies it"])
def test_placeholders_in_parentheses_and_brackets(models, text):
    assert r.is_residue(r.residue_of([text + ". " + REAL], models)[0])


@pytest.mark.parametrize("text", ["run $(date) first", "`$(shelf.title)` is filled", "see [your profile](/me) or [Insert a row][row]", "as said [NOT FOUND] and [1, 2]", "f((x)) and ((a + b)) are equal", "$(a.b) + c$ is x", "[x]: /y"])
def test_no_placeholders_in_links_and_code(models, text):
    assert not r.is_residue(r.residue_of([text + ". " + REAL], models)[0])


@pytest.mark.parametrize(
    "text",
    ["# 404\n\nThe page you requested could not be found.", "Please enable JavaScript to view this page.", "# A\n\nLorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", "Die Seite wurde leider nicht gefunden.", "# B\n\nblah blah xxx asdf blah xxxx", "URLが存在しないか、ページが削除されています。", "TODO: write more. Enter your text."],
)
def test_filler_and_notices(models, text):
    assert r.is_residue(r.residue_of([text], models)[0])


@pytest.mark.parametrize("text", [REAL, "# A\n\n" + REAL + "\n\nPlease enable JavaScript to use the search box.", "The placeholder `{{ a.b }}` is filled later. " + REAL, "```jinja\n{{ x }}\n```\n" + REAL, REAL + "\n\nA page that is missing gives the message: page not found.", "", None, "see $x^{2}$ and \\emph{the} rest. " + REAL, "url%20with%20spaces and 100%. " + REAL])
def test_pages_with_content(models, text):
    assert not r.is_residue(r.residue_of([text], models)[0])


#: Wording that no seed has; each stands on short pages of several sites.
UNSEEN = (
    "The shelf you asked about is empty, nothing is stored under this label.", "Our gatekeeper refused to hand over what you wanted.", "This cupboard was closed by its keeper last spring.",
    "Sorry, the machine behind the curtain fell asleep.", "Turn on scripting, otherwise this window remains blank.", "Visitors without a badge have to wait outside.", "The queue is full, come back after tea.",
    "Hier fehlt die Auskunft, der Schrank ist leer.", "Le rayon demandé est vide, rien ne s'y trouve.", "El estante pedido está vacío y nadie lo atiende.",
    "Somebody will type something nice into this gap.", "Words of the author belong into this gap, please type them.", "Fülltext ohne Sinn, damit die Lücke nicht leer steht.",
)


def _unseen(spark, data):
    real = [(x.fetch_id, x.url, x.source_url, x.markdown) for x in table(spark, data.replace("0.001", "0.01"), "normalized_documents").collect()]
    mine = [(10**6 + 100 * i + j, f"https://site{j}-{i % 4}.example/{i}", None, f"# Part {j}\n\n{t}" + (f"\n\nCase {i * 7919 + j}" if j % 2 else "")) for i, t in enumerate(UNSEEN) for j in range(6)]
    return spark.createDataFrame(real + mine, "fetch_id bigint, url string, source_url string, markdown string")


def test_held_out_wording(spark, data, models):
    """Recall on wording absent from the seeds is at least 0.9 where the corpus repeats it, without a label anywhere."""
    letters = lambda t: re.sub(r"[\W\d_]+", "", t.lower())
    known = {letters(x) for xs in r.seeds().values() for x in xs}
    assert not known & {letters(t) for t in UNSEEN}
    got = {x.fetch_id: x.residue for x in r.coverage(_unseen(spark, data)).collect()}
    mine = [v for i, v in got.items() if i >= 10**6]
    assert sum(mine) / len(mine) >= 0.9
    docs = table(spark, data, "normalized_documents").where("length(markdown) > 2500").collect()
    assert len(docs) > 5 and not any(f["placeholders"] == 0 and r.is_residue(f) for f in r.residue_of([d.markdown for d in docs], models))


def test_no_seed_is_a_line_of_the_tables(spark, data):
    letters = lambda t: re.sub(r"[\W\d_]+", "", t.lower())
    seeds = {letters(x) for xs in r.seeds().values() for x in xs} | {letters(x) for s in (seeds_.FILLER, seeds_.NOTICE, seeds_.FURNITURE) for x in s.split("\n")}
    for sf in ("0.001", "0.01", "0.1"):
        rows = table(spark, data.replace("0.001", sf), "normalized_documents").where("markdown is not null").select("markdown").collect()
        lines = {letters(x) for row in rows for line in row.markdown.split("\n") for x in (line, *(u for u, *_ in r.units(line)))}
        assert not (seeds & lines) - {""}


def test_windows_localise_residue_inside_a_line(models):
    """Half of a long line without a full stop is filler: about half of it is counted as such."""
    line = "the index stores one row for every page and keeps the newest fetch of it so that a reader who asks for an older one gets nothing at all from the store " + "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis"
    share = models.shares([line])[0]
    assert 0.3 < share[r.FILLERS] < 0.65 and share[r.PROSE] > 0.3


def test_table(spark, models):
    rows = [(1, "Please enable JavaScript to view this page.", 1.0), (1, "Please enable JavaScript to view this page.", None), (2, None, 1.0), (3, "", 1.0), (None, REAL, 1.0), (4, REAL * 3000, 1.0)]
    df = spark.createDataFrame(rows, "fetch_id bigint, markdown string, content double")
    assert sorted(x.fetch_id for x in r.scan(r.prepared(df), models).where("residue").collect()) == [1, 1]
    assert r.found(df.limit(0)).count() == 0


def test_lines_of_a_site_are_counted_over_all_rows(spark, models):
    own = "Velkormast publishes the notes of its members every week, and readers may send letters about what they have read there."
    notice = "The page you requested could not be found."
    rows = [(i, f"https://a.example/{i}", None, f"{REAL}\n\nPart {i} of it.\n\n{own}") for i in range(8)] + [(50, "https://a.example/x", None, f"{notice}\n\n{own}")]
    rows += [(60 + i, f"https://b.example/{i}", None, notice) for i in range(6)] + [(70, "https://c.example/", None, f"{notice}\n\n{own}")]
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, source_url string, markdown string")
    got = {x.fetch_id: x for x in r.scan(r.prepared(df, lines=r.lines_of_sites(df)), models).collect()}
    assert {i for i, x in got.items() if x.residue} == {50, *range(60, 66)}
    assert got[50].content == 0 and got[50].furniture >= 100
    assert {x.fetch_id: x.furniture for x in r.coverage(df).collect()}[50] >= 100


def _documents(spark, rows):
    return spark.createDataFrame([(i, f"https://{site}.example/{i}", None, text) for i, (site, text) in enumerate(rows)], "fetch_id bigint, url string, source_url string, markdown string")


def test_every_row_teaches(spark, data):
    """Grams of prose are counted over all lines of all 5,000 rows, however they are split."""
    docs = table(spark, data.replace("0.001", "0.1"), "normalized_documents").select("fetch_id", "markdown")
    rows = r.prepared(docs)
    prose, furniture, _ = r.wordings(rows, r.Fit())
    parts = [r._parts(x.markdown, None) for x in docs.where("markdown is not null").collect()]
    assert len(parts) > 4500
    assert (prose == r._counts([u for us, size in parts if size > 500 for u, _ in us])).all() and not furniture.any()
    again = r.wordings(rows.repartition(3), r.Fit())
    assert (again[0] == prose).all()


def test_phrases_are_words_in_order():
    texts = ["One, two - three FOUR five_six 7!", "one two three four", "", "short", "ページが見つかりません", "a b c d e f", "x Zwei drei vier fünf"]
    p = r.phrases(texts)
    got = [(int(p.of[i]), p.joined[lo:hi]) for i, lo, hi in zip(p.first, p.lo, p.hi)]
    assert got == [(0, "one, two - three four"), (0, "two - three four five_six"), (0, "three four five_six 7"), (1, "one two three four"), (4, "ページが見つかりません"), (6, "x zwei drei vier"), (6, "zwei drei vier fünf")]
    assert p.h[0] == p.h[3] and len(set(p.h.tolist())) == len(p.h) - 1
    assert r.phrases(["nine " * 500 + texts[1]]).h[-1] == p.h[3]


NAMES = ("Vorlandix", "tamperidol", "kuvelmarn", "Osterwyndal", "brivallo", "quellomar", "Zandrivik", "harpelune")


def test_known_phrases_beside_a_name(spark, data):
    """A notice with a name of its own on each of eight sites, among 5,000 real rows."""
    real = [(x.fetch_id, x.url, x.source_url, x.markdown) for x in table(spark, data.replace("0.001", "0.1"), "normalized_documents").collect()]
    said = ("The lantern of {} went dark before supper.", "{} keeps the ladder behind the barn tonight.", "Ask the ferryman of {} to row across tomorrow.")
    mine = [(10**6 + 10 * i + j, f"https://{w.lower()}.example/{i}", None, f"# {j}\n\n{t.format(w)}") for i, t in enumerate(said) for j, w in enumerate(NAMES)]
    got = r.found(spark.createDataFrame(real + mine, "fetch_id bigint, url string, source_url string, markdown string"))
    assert {x.fetch_id for x in got.collect() if x.fetch_id >= 10**6} == {x[0] for x in mine}


def test_common_phrases_are_compared_with_all_full_pages(spark):
    """What full pages say as well is no residue, nor what a few sites copied from one article; what only short pages of several sites say is."""
    said, both = "The lantern went dark before supper.", "The harbour keeps its ladders dry all winter."
    article = " ".join(f"The {w} of the harbour is painted by its {v} in spring, and nobody asks why." for w, v in zip(NAMES, NAMES[::-1]))[:470]
    rows = [(f"s{i}", said) for i in range(6)] + [(f"s{i}", both) for i in range(6)] + [(f"s{i}", article) for i in range(4)]
    rows += [(f"t{i}", f"{both} " + " ".join(f"Barrel {i} of row {j} holds salted fish for the crew of the evening boat." for j in range(12))) for i in range(400)]
    _, _, residue = r.wordings(r.prepared(_documents(spark, rows)), r.Fit())
    got = {x.text: x.sure for x in residue.collect()}
    assert got["the lantern went dark"] and not any("ladders" in t for t in got)
    assert not any(sure for t, sure in got.items() if "painted" in t)


def test_a_long_page_of_a_sites_own_lines_is_short(spark):
    """A page of 20,000 characters whose content is a notice counts as short."""
    own = [f"Line {i} of the members' list of this harbour, kept by the treasurer and read out at supper." for i in range(220)]
    text = "The lantern went dark before supper.\n\n" + "\n".join(own)
    rows = [(i, f"s{i}", text, list(range(2, 222))) for i in range(5)] + [(9, "t", REAL * 100, None)]
    _, _, residue = r.wordings(spark.createDataFrame(rows, "key bigint, site string, text string, lines array<int>"), r.Fit())
    assert {x.text for x in residue.collect()} == {"the lantern went dark", "lantern went dark before", "went dark before supper"}
