"""Leaks against brute force over word windows, and the defined dirty cases."""

from viewmill.llm.leak import ItemAutomaton, decontaminated, item_windows, leak_spans, leaks, plain_text, words
from viewmill.session import table


def brute(docs, items, n=12):
    grams, out = {}, set()
    for item, passage in items:
        w = words(plain_text(passage))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(g) for g in grams}
    for doc, text in docs:
        w = words(plain_text(text))
        for size in sizes:
            for k in range(len(w) - size + 1):
                out |= {(doc, item) for item in grams.get(tuple(w[k : k + size]), ())}
    return out


def test_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    expected = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "passage").collect())
    for block in (100_000, 1000):
        found = {(r.doc_id, r.item_id) for r in leaks(docs, items, block_words=block).collect()}
        assert found == expected and expected


def test_automaton_on_random_words():
    import random

    rng = random.Random(5)
    for _ in range(60):
        make = lambda n: [rng.choice("abc") for _ in range(n)]
        items = [(i, make(rng.randint(0, 14))) for i in range(6)]
        text = make(60)
        found = {m[0] for m in ItemAutomaton(items, 5).matches(text)}
        expected = {i for _, i in brute([(0, " ".join(text))], [(i, " ".join(w)) for i, w in items], 5)}
        assert found == expected


def test_dirty_cases(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, passage), (2, "Short whole passage!"), (3, None), (4, ""), (5, "...")], "item_id long, passage string")
    docs = spark.createDataFrame(
        [
            (1, "x ONE <b>two</b> th​ree four&nbsp;five six\nseven, eight nine ten eleven ｔｗｅｌｖｅ y", "a"),
            (2, "one two three four five six seven eight nine ten eleven", "a"),
            (3, "a short, WHOLE passage here", "a"),
            (4, None, "a"),
            (5, "", "a"),
            (6, "short whole", "a"),
            (1, "x ONE <b>two</b> three four five six seven eight nine ten eleven twelve y", "a"),
        ],
        "doc_id long, text string, item_id string",
    )
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(1, 1), (3, 2)}
    both = [r for r in decontaminated(docs, items, 0.7).collect() if r.doc_id == 1]
    assert sorted((r.action, r.n_words, r.leaked_words) for r in both) == [("drop", 14, 12), ("drop", 14, 12)]
    out = {r.doc_id: r for r in decontaminated(docs, items, 0.95).collect() if r.doc_id == 1}
    assert out[1].action == "trim" and out[1].text == "x  y"
    out = {r.doc_id: r for r in decontaminated(docs.where("doc_id > 1"), items, 0.7).collect()}
    assert out[3].action == "trim" and out[3].text == "a  here" and out[3].leaked_words == 3
    assert out[2].action == out[4].action == "keep" and out[4].text is None
    assert leaks(docs, items.limit(0)).count() == leaks(docs.limit(0), items).count() == 0


def test_repeated_ids_with_different_texts_keep_their_own_spans(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, passage string")
    docs = spark.createDataFrame([(7, "x y z a b c"), (7, "a b c x"), (7, "q"), (7, "a b c x"), (None, "a b c x y z u v")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.action, r.text) for r in decontaminated(docs, items, 0.8).collect())
    assert got == [(0, "trim", " x y z u v"), (7, "keep", "q"), (7, "trim", " x"), (7, "trim", " x"), (7, "trim", "x y z ")]


def test_many_blocks_read_the_corpus_once(spark):
    d = "/root/testdata/sf0.01"
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leak_spans(watched, items, block_words=150, group_words=2000).collect()}
    assert found == {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    assert seen.value == docs.count() and item_windows(items, 12, 150).select("block").distinct().count() >= 50
