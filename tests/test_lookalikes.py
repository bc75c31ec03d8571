from inkstream.operators.structure import lookalike_pairs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
    return row[-1]


def test_pairs_of_other_beginnings(spark):
    words = "achein schein schien scheine hallway allway ällway straßen strassen trassen abcdefgh bbcdefgi xxcdefgh cdefgh xxcdefgi gardens garden cordens élévation elevation".split()
    expected = {(a, b) for a in words for b in words if a < b and edits(a, b) <= (2 if max(len(a), len(b)) >= 8 else 1)}
    found = lookalike_pairs(spark.createDataFrame([(w,) for w in words], "word string"))
    assert {("achein", "schein"), ("allway", "hallway"), ("cdefgh", "xxcdefgh"), ("elevation", "élévation")} <= expected
    assert sorted(map(tuple, found.collect())) == sorted(expected)
