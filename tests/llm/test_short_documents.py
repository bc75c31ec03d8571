"""Documents that are less than a benchmark item."""

from inkstream.llm import decontaminate


def test_part_of_an_item_is_found(spark):
    item = [f"word{i}" for i in range(50)]
    texts = {1: item[:46], 2: item[4:], 3: item, 4: item[:30], 5: ["other", *item, "other"], 6: item[:3], 7: item[2:48]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    rows = decontaminate.matches(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    found = {r.doc_id: (r.start_word, r.n_words) for r in rows}
    assert found == {1: (0, 46), 2: (0, 46), 3: (0, 50), 5: (1, 50), 7: (0, 46)}
    letters = [sum(map(len, item[i : i + 5])) for i in range(46)]
    shares = {r.doc_id: r.similarity for r in rows}
    assert abs(shares[1] - sum(letters[:42]) / sum(letters)) < 1e-9 and abs(shares[2] - sum(letters[4:]) / sum(letters)) < 1e-9
