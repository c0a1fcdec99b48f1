"""The text problems: whole small tables against plain Python, and the cases of each operator."""

import json
import random

import brute_llm
import pytest

from slotweave.llm import cells, containment, packing, queries, residue


def test_cells_of_each_layout():
    want = [("markdown", "# T"), ("code", "x = 1\ny"), ("output", "1\n2"), ("markdown", "end")]
    book = {"cells": [{"cell_type": "markdown", "source": "# T"}, {"cell_type": "code", "source": ["x = 1\n", "y"], "outputs": [{"text": ["1\n", "2"]}]}, {"cell_type": "markdown", "source": ["end"]}, None]}
    assert cells.read_cells(json.dumps(book)) == ("ipynb", want)
    assert cells.read_cells("# %% [markdown]\n# # T\n# %%\nx = 1\ny\n# %% [output]\n# 1\n# 2\n# %% [markdown]\n# end") == ("percent", want)
    assert cells.read_cells("# # T\n\n# In[1]:\n\nx = 1\ny\n\n# Out[1]:\n#  1\n#  2\n\n# end\n") == ("script", want)
    assert cells.read_cells("# T\n\n```python\nx = 1\ny\n```\n\n```text\n1\n2\n```\n\nend\n") == ("fence", want)
    assert cells.read_cells("# T\nIn [1]: x = 1\ny\nOut[1]: 1\n2\nend")[0] == "plain"
    for text in ("", "{", "{}", '{"cells": 3}', "```", "# %%", "\x00"):
        cells.read_cells(text)


def test_empty_code_cell_of_a_script():
    for gap in ("\n\n\n\n", "\n\n \n\n", "\n\n\n\n\n"):
        assert cells.read_cells(f"# In[1]:{gap}# Dear reader\n\n# In[2]:\n\n# x\n")[1] == [("code", ""), ("markdown", "Dear reader"), ("code", "# x")]
    assert cells.read_cells("# In[1]:\n\n\n\n# In[2]:\n\n# x\n\n# In[3]:\n\n\n")[1] == [("code", ""), ("code", "# x"), ("code", "")]
    for gap in ("\n\n", "\n\n\n"):
        assert cells.read_cells(f"# In[1]:{gap}# Your text goes here.\n")[1][0][0] == "code"


def test_fill_window_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room, sums = rng.randint(0, 80), {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill_window(room, sorted(counts), counts)
        assert all(0 < n <= counts[length] for length, n in chosen.items())
        assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_item_once():
    rng = random.Random(5)
    histogram = {rng.randint(1, 200): rng.randint(1, 40) for _ in range(120)}
    plan = packing.plan_containers(histogram, 500)
    used = {}
    for repeats, filling in plan:
        assert sum(length * n for length, n in filling.items()) <= 500
        for length, n in filling.items():
            used[length] = used.get(length, 0) + n * repeats
    assert used == histogram
    total = sum(length * n for length, n in histogram.items())
    assert sum(r for r, _ in plan) <= -(-total // 500) * 1.02 + 1
    assert packing.plan_containers({}, 500) == []


def test_plan_in_groups(spark):
    rng = random.Random(6)
    histogram = {length: rng.randint(1, 9) for length in rng.sample(range(1, 9000), 3000)} | {9001: 40, 16_384: 3}
    plan = packing.plan_in_groups(spark, histogram)
    used, total = {}, sum(length * n for length, n in histogram.items())
    for repeats, filling in plan:
        assert sum(length * n for length, n in filling.items()) <= packing.CAPACITY
        for length, n in filling.items():
            used[length] = used.get(length, 0) + n * repeats
    assert used == histogram and sum(r for r, _ in plan) <= -(-total // packing.CAPACITY) * 1.001 + 1
    assert plan == packing.plan_in_groups(spark, dict(reversed(histogram.items())))
    hard = {length: 5 for length in range(9000, 16_000, 2)}  # nothing fits beside another
    assert sum(r for r, _ in packing.plan_in_groups(spark, hard)) == sum(hard.values())


def test_audit_sees_each_fault(spark):
    documents = spark.createDataFrame([(1, "a" * 9), (2, "b" * 4), (3, "c" * 14), (4, None)], "doc_id BIGINT, text STRING")
    columns = "doc_id BIGINT, piece INT, pieces INT, length BIGINT, container BIGINT, position BIGINT"
    good = [(1, 0, 1, 10, 0, 0), (2, 0, 1, 5, 1, 0), (3, 0, 2, 10, 2, 0), (3, 1, 2, 5, 1, 5)]
    ask = lambda placed: tuple(packing.audit(documents, spark.createDataFrame(placed, columns), 10).first())
    assert ask(good) == (3, 30, 0, 0, 0, 0, True)
    assert ask(good[:3])[2] == 1 and ask([])[2] == 3
    assert ask([(1, 0, 1, 6, 0, 0), (1, 1, 1, 4, 3, 0), *good[1:]])[3] == 1
    assert ask([(1, 0, 1, 10, 1, 10), *good[1:]])[4] == 1
    assert ask([*good[:3], (3, 1, 2, 5, 1, 4)])[5] == 1
    assert ask(packing.pack_documents(documents, 10).select("doc_id", "piece", "pieces", "length", "container", "position").collect()) == (3, 30, 0, 0, 0, 0, True)


def test_pack_cases(spark):
    items = [(1, 10), (2, 10), (3, 7), (4, 3), (5, 25), (6, 20), (None, 5), (7, None), (8, 0), (9, 10), (9, 10), (10, 1)]
    got = packing.pack(spark.createDataFrame(items, "name BIGINT, size BIGINT"), "name", "size", 10).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.id, []).append(r.length)
    assert {k: sorted(v) for k, v in pieces.items()} == {1: [10], 2: [10], 3: [7], 4: [3], 5: [5, 10, 10], 6: [10, 10], 9: [10, 10], 10: [1]}
    spans = {}
    for r in got:
        spans.setdefault(r.container, []).append((r.position, r.position + r.length))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 10 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert sorted(spans) == list(range(len(spans)))
    assert packing.pack(spark.createDataFrame([], "name BIGINT, size BIGINT"), "name", "size", 10).count() == 0


def test_pack_documents_leaves_little_space(spark, data):
    df = packing.pack_documents(spark.read.parquet(f"{data}/documents.parquet"), 16_384)
    rows = df.collect()
    total, n = sum(r.length for r in rows), len({r.container for r in rows})
    assert n == -(-total // 16_384)
    want = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text is not None and len(r.text.encode()) + 1 > 16_384}
    assert {r.doc_id for r in queries.p6_found(spark, data).collect()} == want


def test_leaks_whole_tables(spark, data):
    got = [tuple(r) for r in queries.p7_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_llm.p7(data)


def test_leak_cases(spark):
    long_item = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, long_item, "x"), (2, "One two, three!", "x"), (3, "...", "x"), (4, None, "x"), (5, "a b c d e f g", "x"), (None, "q r s", "x"), (6, "é", "x")], "item_id BIGINT, text STRING, doc_id STRING")
    raw = json.dumps({"cells": [{"cell_type": "markdown", "source": ["a b\n", "c d e"]}, {"cell_type": "code", "source": "f", "outputs": [{"text": "g"}]}]})
    docs = [
        (1, "start " + " ".join(f"W{i}," for i in range(20, 33)) + " end"),
        (2, " ".join(f"w{i}" for i in range(20, 32))),
        (3, "zero ONE\n#  two___three"),
        (4, "one twothree"),
        (5, raw),
        (6, None),
        (7, ""),
        (8, "café É"),
        (9, "one two"),
        (10, "three one two"),
        (None, "one two three"),
        (3, "one two three"),
    ]
    got = containment.leaked_items(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), items).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 2), (5, 5), (8, 6)]
    assert containment.leaked_items(spark.createDataFrame([], "doc_id BIGINT, text STRING"), items).count() == 0
    assert containment.leaked_items(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), items.limit(0)).count() == 0


def test_window_does_not_cross_documents():
    index = containment.PassageIndex(containment.passages_of(1, "one two three four five six"))
    assert index.search([(1, "one two three"), (2, "four five six")]) == set()
    assert index.search([(1, "one two three"), (2, "x one two three four five six y")]) == {(2, 1, 0)}


def test_shingle_containment():
    own = tuple("a b c d e f g".split())
    assert containment.shingle_containment(own, ("x", *own, "y")) == 1
    assert containment.shingle_containment(own, (*own[:6], "y")) == pytest.approx(2 / 3)
    assert containment.shingle_containment(("a", "b"), own) == 1 and containment.shingle_containment(("b", "a"), own) == 0


def test_long_span_over_the_cut_of_a_very_long_text(spark):
    """A passage longer than usual that lies across the place where a very long text is cut."""
    passage = " ".join(f"p{i}" for i in range(30))
    items = spark.createDataFrame([(1, passage)], "item_id BIGINT, text STRING")
    filler = "lorem " * ((4 * containment._CHUNK - 60) // 6)
    docs = spark.createDataFrame([(1, filler + passage + " end " + filler)], "doc_id BIGINT, text STRING")
    for span in (13, 25):
        assert [tuple(r) for r in containment.leaked_items(docs, items, span).collect()] == [(1, 1)]


def test_index_and_join_agree(spark, data, monkeypatch):
    documents, items = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "eval_items"))
    want = sorted(map(tuple, containment.leaked_items(documents, items).collect()))
    shares = sorted(map(tuple, containment.leaked_shares(documents, items).collect()))
    monkeypatch.setattr(containment, "INDEX_PASSAGES", 10)
    assert sorted(map(tuple, containment.leaked_items(documents, items).collect())) == want
    assert sorted(map(tuple, containment.leaked_shares(documents, items).collect())) == shares
    assert [r[:2] for r in shares] == want and all(0 < found <= of for _, _, found, of in shares)
    assert containment.leaked_items(documents, items.limit(0)).count() == 0


def test_many_passages_in_one_scan(spark, monkeypatch):
    """More passages than the index takes are joined: the texts are read once."""
    monkeypatch.setattr(containment, "INDEX_PASSAGES", 100)
    items = spark.range(300).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(0, 29), i -> concat('w', id * 31 + i))) AS text")
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('x ', concat_ws(' ', transform(sequence(3, 20), i -> concat('W', id * 31 + i))), ' y') AS text")
    assert sorted(map(tuple, containment.leaked_items(docs, items).collect())) == [(i, i) for i in range(300)]

def test_minhash_of_windows():
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    shingles = containment._shingles(hashes, 5)
    for size, first, _ in containment.window_minhashes(hashes, [3, 5, 9, 13, 60, 61]):
        if size >= 5:
            assert first.tolist() == [shingles[i : i + size - 4].min() for i in range(60 - size + 1)]


def _flagged(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    return {r.doc_id for r in residue.leftover_documents(df).collect()}


def test_residue_cases(spark):
    prose = "We keep 12 rows for training. The scraper skips every page that says \"please enable JavaScript\", which cost us 3 of 10 rows."
    yes = [
        "Please enable JavaScript to view this notebook.",
        "# %% [markdown]\n# # Title 3\n# %% [output]\n# 500 Internal Server Error\n# \n# Request id 73015\n# %%\nx = 1",
        "# T\n\n```python\nx\n```\n\nProject {{ title }} by <your name here>.\n\nMore prose about rows and columns.\n",
        "In [1]: x = 1\nOut[1]: ACCESS  DENIED.  Reference 17.\nSome prose.",
        json.dumps({"cells": [{"cell_type": "markdown", "source": "Lorem ipsum dolor verat posulus nolis velor."}]}),
        "# Description: [votre titre ici]\n# \n# Goal: TBD (goal)\n\n# In[1]:\n\nx\n",
    ]
    no = [
        None,
        "",
        prose,
        "# %% [markdown]\n# " + prose,
        "# %%\n# Please enable JavaScript to view this notebook.\n# %% [output]\n# 3 pages read, 2 answered 503 Service Unavailable, mean db 3.5",
        "In [1]: page = '<h1>{{ title }}</h1>'\nOut[1]: rendered: Dear {{ name }}, -> Dear Tavi, (9 chars)",
        "# T\n\n```text\nGET /x/3 -> 404 Not Found\nGET /x/4 -> 200 OK\n```\n",
        json.dumps({"cells": [{"cell_type": "code", "source": "# lorem ipsum dolor amet", "outputs": [{"text": "404 12\n503 7"}]}]}),
        "# # Numbers\n\n# Out[1]:\n#  404\n#  503\n",
    ]
    filler = ["Ordinary notebook text about rows %d." % i for i in range(30)]
    assert _flagged(spark, yes + no + filler) == set(range(len(yes)))
    assert _flagged(spark, []) == set()


def test_residue_behind_an_empty_code_cell(spark):
    texts = ["# In[1]:\n\n\n\n# Please enable JavaScript to view this notebook.\n", "# In[1]:\n\n# Please enable JavaScript to view this notebook.\n"]
    filler = ["Ordinary notebook text about rows %d." % i for i in range(30)]
    assert _flagged(spark, texts + filler) == {0}


def test_messages_over_many_lines(spark):
    """Windows grow with the exemplars, also where the layout does not mark a cell's end."""
    page = "<html>\n<head>\n<title>502 Bad Gateway</title>\n</head>\n<body>\n<center>\n<h1>502 Bad Gateway</h1>\n</center>\n<hr>\n<center>nginx</center>\n</body>\n</html>"
    texts = [f"In [1]: x = 1\nOut[1]: 7\n{page}\nSome prose about rows.", "In [1]: x\nOut[1]: Lorem\nipsum\ndolor\nverat\nposulus\nnolis\nvelor\ntarim\n", page]
    texts += ["In [1]: x\nOut[1]: retry(codes=(502, 503), wait=3)  # Service Unavailable, Bad Gateway\n"]
    filler = ["Ordinary notebook text about rows %d." % i for i in range(30)]
    assert _flagged(spark, texts + filler) == {0, 1, 2}


# Wording that stands in no exemplar.  Notices of servers, viewers and templates, and texts that only speak of such.
UNSEEN = [
    "Bandwidth limit exceeded", "[Company name]\n[Street address]", "INSERT TITLE HERE", "408 Request Timeout", "410 Gone", "HTTP Error 404. The requested resource is not found.", "Error 503 Service Unavailable\n\nBackend fetch failed",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. Lorem ipsum dolor sit amet", "Your session timed out. Please log in again.", "This site requires JavaScript to be enabled.",
    "You have JavaScript disabled.", "Activez JavaScript pour continuer.", "Placeholder text goes here.", "Enter your description here", "Dear [Name],", "Author: <your name>\nDate: <enter date>", "<h1>Forbidden</h1><p>You don't have permission to access this resource.</p>",
    "Vestibulum lorem ipsum pharetra morbi tristique senectus netus malesuada", "To use this viewer, allow JavaScript for this site.", "Please log in to view this page.",
]
ORDINARY = [
    "Results", "Check your data", "Your own words matter here: describe the plot.", "JavaScript libraries", "Continue with page 3", "The placeholder {{ name }} is filled from the table.", "not found: 3 of 12 keys", "0 errors, 0 warnings",
    "Error rate by region", "test accuracy: 0.93", "HTTP status codes such as 404 and 503 were removed from the log.", "Typesetters use lorem ipsum; we use real text.", "first words: ['lorem', 'ipsum', 'wing', 'mm']", "This is the text we want to classify.",
    "Name: Anna\nDate: 2020", "KeyError: 'title'", "Time out of service (hours)", "GET /wing_mm/9 -> 404 Not Found", "9 pages read, 2 answered 503 Service Unavailable, mean age 9.9", "rendered: Dear {{ name }}, -> Dear Tavi, (9 chars)",
]


def _index(corpus):
    frequency, kept = {}, []
    for doc_id, text in corpus:
        own, cells_ = residue.candidate_cells(text)
        for term in [*own, ""]:
            frequency[term] = frequency.get(term, 0) + 1
        kept += [(doc_id, *cell) for cell in cells_]

    def build(leave_out=frozenset()):
        index = residue.ExemplarIndex(leave_out)
        index.weigh(len(corpus), frequency)
        return index

    return build, kept


def test_wording_that_no_exemplar_has(spark, data):
    """Recall and precision on texts outside the exemplars, and recall where a fifth of the exemplars is left out."""
    corpus = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if r.text is not None]
    build, kept = _index(corpus)
    index = build()
    assert sum(residue.leftover_cell(index, text, False) for text in UNSEEN) >= 0.9 * len(UNSEEN)
    assert not [text for text in ORDINARY if residue.leftover_cell(index, text, False)]
    whole = {doc_id for doc_id, loose, body in kept if residue.leftover_cell(index, body, loose)}
    texts = [t for own in (*residue.MESSAGES.values(), *residue.KERNELS.values(), residue.TEMPLATES) for t in own]
    found = 0
    for fold in range(5):
        index = build(frozenset(texts[fold::5]))
        again = {doc_id for doc_id, loose, body in kept if residue.leftover_cell(index, body, loose)}
        assert again <= whole
        found += len(again)
    assert found >= 0.9 * 5 * len(whole) > 0


def test_terms():
    assert residue.terms("Project ${X} by {{ cookiecutter.name }}. 404") == ["project", "§", "by", "§"]
    assert residue.terms("Author: [Your name]\n- [Company name].\nx [a](b) [1]") == ["author", "§", "§", "x", "a", "b"]
    assert residue.terms("TODO: add license; TBD (x); __NAME__ __init") == ["§", "§", "§", "init"]


@pytest.mark.parametrize("text", ["x" * 300_000, "lorem " * 50_000, "{" * 5_000, "# %%\n" * 5_000])
def test_long_texts(text):
    residue.candidate_cells(text)
    containment.PassageIndex(containment.passages_of(1, "a b c")).search([(1, text)])


def test_pieces_of_very_long_texts_lose_no_passage():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "-"]) + f"w{i}" * rng.choice([1, 1, 1, 3]) for i in range(rng.randint(0, 200))) + " " * rng.choice([0, 0, 400])
        own = containment.words(text)
        want = {tuple(own[i : i + 4]) for i in range(len(own) - 3)}
        parts = [containment.words(p) for p in containment._pieces(text, size=rng.randint(5, 120), overlap=4)]
        assert {tuple(p[i : i + 4]) for p in parts for i in range(len(p) - 3)} == want
        assert set(own) == {w for p in parts for w in p}
