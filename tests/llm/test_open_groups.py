"""Near-duplicates: shared tokens and the rounds before all that is open meets."""

from docloom.llm import simhash as N


def test_shared_tokens_are_the_repeated_ones_with_two_before(spark):
    fronts = spark.createDataFrame([(1, 9, [5, 6, 7]), (2, 9, [7, 5]), (3, 9, [8]), (4, 9, [])], "fp long, size long, front array<long>")
    got = {tuple(r) for r in N.shared_tokens(fronts).select("token", "fp", "size", "pos", "prev", "prev2").collect()}
    assert got == {(5, 1, 9, 0, None, None), (7, 1, 9, 2, 6, 5), (7, 2, 9, 0, None, None), (5, 2, 9, 1, 7, None)}


def test_strays_meet_a_bounded_number_of_the_main_component(spark):
    main, strays = range(1, 801), range(1001, 1021)
    rows = spark.createDataFrame([(1, i, 50, 0) for i in [*main, *strays]], "token long, fp long, size long, pos long")
    roots = spark.createDataFrame([(i, 1) for i in main], "fp long, root long")
    turns = [{tuple(r) for r in N.open_stars(rows, roots, 0.8, t).collect()} for t in range(2)]
    for pairs in turns:
        assert {b for _, b in pairs} == set(strays)
        assert all(a in main for a, _ in pairs)
        assert len(pairs) <= len(strays) * N.CENTRES  # all of them would be 20 * 800
    assert turns[0] != turns[1]
