"""Queries over whole tables, on small fixtures, against plain versions without cuts."""

import pytest

from quire.plans import catalog


def rows_of(spark, tmp_path, query, **tables):
    """The query's rows over tables given as (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return catalog.QUERIES[query](spark, str(tmp_path)).collect()


def n_lines(runs):
    """Lines of (bottom, seq, size), each run put into the first line whose first run is near enough."""
    firsts = []
    for bottom, _, size in sorted(runs, key=lambda r: (-r[0], r[1])):
        if not any(abs(b - bottom) <= max(1.5, 0.35 * max(s, size)) for b, s in firsts):
            firsts.append((bottom, size))
    return len(firsts)


def test_line_cluster_has_every_order(spark, tmp_path):
    items = [(order, line, order * line % 11, 1, float(line), (order * 3 + line * 5) % 9 / 100) for order in range(1, 30) for line in range(1, order % 7 + 2)]
    got = rows_of(spark, tmp_path, "line_cluster", lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_tax double"))
    want = {}
    for order, line, _, _, _, tax in items:
        want.setdefault(order, []).append((700 - line * 2.0 - tax * 20, line, 8.0 + line % 3))
    assert {r.doc: r.n_lines for r in got} == {order: n_lines(runs) for order, runs in want.items()} and len(got) == 29


EVENTS = "event_id long, user_id long, event_type string, value double"


def test_policy_visibility_counts_every_event(spark, tmp_path):
    # each policy with sets all on, all off and mixed; a user with one event that no multiple of three numbers
    states = {user: ([90.0] * 3, [10.0] * 3, [90.0, 10.0, 10.0], [90.0])[user // 5] for user in range(20)}
    events = [(10 * user + 1 + i, user, "click", value) for user, values in states.items() for i, value in enumerate(values)]
    got = {r.user_id: (r.policy, r.visible) for r in rows_of(spark, tmp_path, "policy_visibility", events=(events, EVENTS))}
    rules = [("AnyOn", any), ("AllOn", all), ("AnyOff", lambda on: not all(on)), ("AllOff", lambda on: not any(on)), ("Odd", any)]
    assert got == {user: (rules[user % 5][0], rules[user % 5][1]([v > 50 for v in values])) for user, values in states.items()}


def test_choice_options_take_every_event(spark, tmp_path):
    types = {1: ["click"], 2: ["view", "purchase"], 3: ["view"], 4: [], 5: ["click", "view", "purchase", "click"], 7: ["other"]}
    events = [(10 * user + 1 + i, user, kind, 1.0) for user, kinds in types.items() for i, kind in enumerate(kinds)]
    got = {(r.user_id, r.export): r.selected for r in rows_of(spark, tmp_path, "choice_options", events=(events, EVENTS))}
    exports = ["click", "view", "purchase"]
    assert got == {(user, x): (i == user % 2 if user % 3 == 0 else x in kinds) for user, kinds in types.items() if kinds for i, x in enumerate(exports)}


TURNS = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("query", ["layout_join", "layout_raw", "layout_area", "layout_columns"])
def test_layouts_have_all_words(spark, tmp_path, query):
    sizes = {(1, 0): 3, (1, 1): 20, (2, 0): 41, (2, 1): 330, (3, 0): 1203}
    words = {at: ["w" + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(n)] for at, n in sizes.items()}
    got = rows_of(spark, tmp_path, query, conversations=([(doc, page, "user", " ".join(w)) for (doc, page), w in words.items()], TURNS))
    want = {}
    for at, w in words.items():
        lines = [w[i : i + 8] for i in range(0, len(w), 8)]
        if query == "layout_join":
            want[at] = "\n".join(" ".join(x) for x in lines)
        elif query == "layout_raw":
            want[at] = "".join(reversed(w))
        elif query == "layout_area":
            want[at] = "\n".join(" ".join(x[1:4]) for x in lines if len(x) > 1)
        elif len(w) > 15:
            want[at] = "\n".join([" ".join(x[:3]) for x in lines] + [" ".join(x[5:]) for x in lines if len(x) > 5])
    assert {(r.doc, r.page): r.text for r in got} == want


def test_outline_titles_are_whole_texts(spark, tmp_path):
    texts = {(1, 0): "short", (1, 1): "long text " * 60 + "end", (1, 2): "two\nlines, é and 漢字 " * 40 + ".", (2, 0): "x" * 41}
    turns = [(conv, turn, "user" if turn % 2 == 0 else "assistant", text) for (conv, turn), text in texts.items()]
    got = rows_of(spark, tmp_path, "pdf_outline", conversations=(turns, TURNS))
    assert {(r.doc_id, r.preorder): (r.title, r.depth) for r in got} == {at: (text, at[1] % 2) for at, text in texts.items()}


def test_info_values_are_whole_urls(spark, tmp_path):
    urls = {1: "http://a.example/" + "long/" * 40, 2: "http://b.example/"}
    got = rows_of(spark, tmp_path, "pdf_info", pages=(list(urls.items()), "page_id long, url string"))
    assert {r.doc_id: r.value for r in got if r.key == "Title"} == urls


def test_element_counts_of_every_page(spark, tmp_path):
    sizes = {(1, 0): 5, (1, 1): 320, (1, 2): 321, (1, 3): 1000, (2, 1): 0, (2, 4): 0}
    turns = [(conv, turn, "user", " ".join(["word"] * n)) for (conv, turn), n in sizes.items()]
    got = rows_of(spark, tmp_path, "pdf_element_counts", conversations=(turns, TURNS))
    want = {}
    for (conv, turn), n in sizes.items():
        for page in range(max(1, -(-n // 320))):
            found = (-(-min(320, n - 320 * page) // 8), turn % 4 if page == 0 else 0, 0)
            if any(found):
                want[conv * 100 + turn, page] = found
    assert {(r.doc_id, r.page): (r.n_text, r.n_paths, r.n_images) for r in got} == want
