import numpy as np

from postlab.llm import quality as Q


def rows_of(n, seed):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        grade = int(rng.integers(0, 3))
        words = [f"w{rng.integers(0, 60)}" for _ in range(40)]
        words += {0: ["vile", "nasty"], 1: ["GO!!"] * 30, 2: []}[grade]
        out.append((i, " ".join(words), grade))
    return out


def test_held_out_grades(spark):
    rows = rows_of(500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    grades = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 350] + [(1, None), (999, 2)],
                                   "doc_id long, grade int")
    model = Q.train(docs, grades)
    assert model.thresholds[0] < model.thresholds[1]
    scored = Q.score(docs.withColumnRenamed("text", "t"), model, "t").collect()
    held = {r.doc_id: r for r in scored if r.doc_id >= 350}
    right = [round(held[i].expected_grade) == g for i, _, g in rows if i >= 350]
    assert np.mean(right) > 0.9
    assert all(r.selected == (r.tail_probability >= Q.SELECT) for r in scored)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (2, "", "k"), (3, "word " * 90_000, "k")],
                                 "doc_id long, text string, selected string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert Q.train(docs, none) is None
    assert [r.expected_grade for r in Q.score(docs, None).collect()] == [None] * 4
    model = Q.Model(np.zeros((1 << Q.BITS) + Q.SHARES), np.array([-1.0, 1.0]))
    values = {r.expected_grade for r in Q.score(docs, model).collect()}
    assert len(values) == 1 and abs(values.pop() - 1.0) < 1e-9


def test_the_slope_is_that_of_the_likelihood(monkeypatch):
    """A weight that separates the grades grows, one that does not stays small."""
    buckets = [np.array([5, 9]) if i % 2 else np.array([9]) for i in range(40)]
    weights, cuts = Q.cumulative_link(buckets, np.zeros((40, Q.SHARES)), np.arange(40) % 2, np.ones(40), 2)
    assert weights[5] > 2 and abs(weights[9]) < weights[5] and cuts.shape == (1,)


def test_repeated_documents_add_nothing_to_the_fit(spark):
    rows = rows_of(120, 2)
    docs = [r[:2] for r in rows] + [rows[0][:2]] * 500 + [(rows[1][0], "zz later text")] * 300
    grades = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, grade int")
    one, many = (Q.train(spark.createDataFrame(d, "doc_id long, text string").repartition(3), grades)
                 for d in ([r[:2] for r in rows], docs))
    assert np.allclose(one.weights, many.weights) and np.allclose(one.thresholds, many.thresholds)


def test_few_graded_texts_have_weights_if_asked(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, "good"), (3, "bad"), (4, "good")], "doc_id long, text string")
    grades = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, grade int")
    assert not Q.train(docs, grades).weights[:1 << Q.BITS].any()
    model = Q.train(docs, grades, least_texts=1)
    scored = {r.doc_id: r.expected_grade for r in Q.score(docs, model).collect()}
    assert scored[1] < 0.5 < scored[2]
