
from pyspark.sql import functions as F

from pitlane.plans.clusters import choose_k
from pitlane.plans.safety import pick_kernel

SILHOUETTES = {2: 0.5115, 3: 0.3574, 4: 0.3948, 5: 0.4198, 6: 0.3469, 7: 0.3628, 8: 0.3319}
REPORT = {  # per class: precision, recall, f1, support
    "ALERTA": (0.933776837012398, 0.9767515419895619, 0.954780861096081, 6323),
    "CRÍTICO": (0.9830331506134169, 0.9668806161745828, 0.9748899818793684, 7790),
    "NORMAL": (0.9971509971509972, 0.9706362153344209, 0.9837149706538811, 6130),
}
MACRO = (0.9713203282589373, 0.9714227911661886, 0.9711286045431101)
WEIGHTED = (0.9719228768583471, 0.9711011213752903, 0.9712811892337643)


def test_best_k_is_argmax_smallest_on_tie():
    assert choose_k(SILHOUETTES) == 2
    assert choose_k({2: 0.4, 3: 0.5, 4: 0.5}) == 3


def test_kernel_tie_goes_to_rbf():
    assert pick_kernel([("linear", 1.0), ("rbf", 1.0)]) == "rbf"
    assert pick_kernel([("linear", 1.0), ("rbf", 0.9)]) == "linear"


def test_split_sizes(spark):
    """The published sizes by the package's own split: 20 % of 99,457 and of 101,215 rows, rounded up."""
    from pitlane.operators.sampling import exact_split

    for n, test in ((99457, 19892), (101215, 20243)):
        df = spark.range(n).select(F.col("id").cast("string").alias("row_key"))
        assert exact_split(df).filter("is_test").count() == test


def test_class_balance(spark):
    from pitlane.plans.models import class_weights

    df = spark.range(101215).select((F.col("id") < 5061).cast("int").alias("y"))
    got = {r["y"]: (r["n"], r["weight"]) for r in class_weights(df, "y").collect()}
    assert got[1][0] == 5061 and round(100 * got[1][0] / (got[0][0] + got[1][0]), 2) == 5.0
    assert abs(got[1][1] - 101215 / (2 * 5061)) < 1e-9


def test_report_of_the_published_confusion(spark):
    """Labels with the published supports and hits give the published rows, macro and weighted averages."""
    from pitlane.operators.evaluate import classification_report

    hits = {c: round(v[1] * v[3]) for c, v in REPORT.items()}
    predicted = {c: round(hits[c] / v[0]) for c, v in REPORT.items()}
    wrong_in = {c: v[3] - hits[c] for c, v in REPORT.items()}
    wrong_out = {c: predicted[c] - hits[c] for c in REPORT}
    pairs = [(c, c, hits[c]) for c in REPORT]
    for t in REPORT:  # any filling of the off-diagonal cells with these margins gives the same report
        for p in REPORT:
            if t != p and (n := min(wrong_in[t], wrong_out[p])):
                pairs.append((t, p, n))
                wrong_in[t] -= n
                wrong_out[p] -= n
    df = spark.createDataFrame(pairs, "t string, p string, n long").select("t", "p", F.explode(F.sequence(F.lit(1), "n")))
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in classification_report(df, "t", "p").collect()}
    left = sum(wrong_in.values())
    for name, want in (*((c, v[:3]) for c, v in REPORT.items()), ("macro avg", MACRO), ("weighted avg", WEIGHTED)):
        assert all(abs(a - b) < (1e-9 if not left else 5e-3) for a, b in zip(got[name], want)), (name, left)
