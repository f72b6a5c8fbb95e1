from quillon.operators import packed


def values(spark, rows, fields=None):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "id bigint, t string, text string")
    got = packed.split_packed(df, "id", fields or {"t": 1}).orderBy("id", "pos").collect()
    out = {}
    for r in got:
        out.setdefault(r.id, []).append(r.value)
        assert r.pos == len(out[r.id])
    return [out.get(i, []) for i in range(len(rows))]


def test_pieces():
    p = lambda t: [x[2] for x in packed.pieces(t)]
    assert p('["A ""x"" B", \'C\'\'s\', D]') == ['A "x" B', "C's", "D"]
    assert p("; a ;; b|c\td、e and f & g,") == list("abcdefg")
    assert p(" N/A ") == p("") == p("{}") == p('"-"') == []
    assert p('"Crime | True", "Music; Live"') == ["Crime | True", "Music; Live"]
    assert p("{\"Q \\\"R\\\" G\",x}") == ['Q "R" G', "x"]
    assert p('"open, x') == ['"open', "x"]


def test_values_with_inner_delimiters_are_learned(spark):
    rows = ['"Docu/Drama", "War"'] * 5 + ["War/Crime", "Crime, War", "Docu/Drama", "Docu/Drama|War", None, "", "  ", "null", "War,,War; "] + ["War"] * 5 + ["Crime"] * 5
    got = values(spark, rows)
    assert got[0] == ["Docu/Drama", "War"] and got[5] == ["War", "Crime"] and got[7] == ["Docu/Drama"] and got[8] == ["Docu/Drama", "War"]
    assert got[9:13] == [[], [], [], []] and got[13] == ["War", "War"]


def test_people(spark):
    rows = ["Ann Lee, Bob Ray", "Lee, Ann; Ray, Bob; van der Moe, Cy", "Lee, Ann | Ray, Bob", "'Ann Lee, Jr.', 'Bob Ray'", "Ann Lee and Bob Ray", '"Lee, Ann", "Ray, Bob"'] * 3
    got = values(spark, rows, {"t": 2})
    assert got[0] == ["Ann Lee", "Bob Ray"] and got[1] == ["Lee, Ann", "Ray, Bob", "van der Moe, Cy"] and got[2] == ["Lee, Ann", "Ray, Bob"]
    assert got[3] == ["Ann Lee, Jr.", "Bob Ray"] and got[4] == ["Ann Lee", "Bob Ray"]


def test_long_and_empty(spark):
    assert len(values(spark, [",".join(["ab"] * 20000)])[0]) == 20000
    assert values(spark, []) == []


def test_name_with_several_additions(spark):
    rows = ["Lee, Ann; Ray, Bob", "Lee, Ann, Jr.; Ray, Bob", "Moe, Cy, Jr., Ph.D.; Ray, Bob", "Ray, Bob; Moe, Cy, Jr., Ph.D., Esq.", "Moe, Cy, Jr., Ph.D., (II)"] * 3
    got = values(spark, rows, {"t": 2})
    assert got[2] == ["Moe, Cy, Jr., Ph.D.", "Ray, Bob"] and got[3] == ["Ray, Bob", "Moe, Cy, Jr., Ph.D., Esq."] and got[4] == ["Moe, Cy, Jr., Ph.D., (II)"]
    assert got[1] == ["Lee, Ann, Jr.", "Ray, Bob"]


def test_values_of_many_pieces_are_shown_by_quoted_ones(spark):
    long = "Film / Play / Song / Dance / Mime"
    rows = [f'"{long}", "War"', f'"{long}", "Crime"', f"{long}", f"{long}|War"] * 6 + ["War"] * 6 + ["Crime|War"] * 6
    got = values(spark, rows)
    assert got[0] == [long, "War"] and got[2] == [long] and got[3] == [long, "War"] and got[-1] == ["Crime", "War"]
    assert packed.quoted_parts('"A, B", C, "D"') == [2, 1]


def test_frequent_keys_lose_nothing(spark):
    left = spark.createDataFrame([("a", i) for i in range(900)] + [(str(i), i) for i in range(100)], "k string, i int")
    right = spark.createDataFrame([("a", 900)] + [(str(i), 1) for i in range(90)], "k string, w bigint")
    assert packed.meet(left, right, ["k"], "w").count() == 990 and packed.meet(left, right, ["k"], "w", "left").count() == 1000
    assert packed.meet(left, right.limit(0), ["k"], "w", "left").count() == 1000 and packed.meet(left.limit(0), right, ["k"], "w").count() == 0
