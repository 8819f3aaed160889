import re

from skrift.sources import programs as P


def test_spans_are_shuffled_once_and_drop_caps_stay_in_their_block(spark):
    rest = " ".join(["och mer text"] * 30)
    big, small = ("Serif", 10.0), ("Sans", 14.0)
    lines = [
        (1, 0, 0, *small, "Rubrik ett"), (1, 0, 1, *big, "början av text som är lång"), (1, 1, 0, "Serif", 40.0, "V"), (1, 1, 1, *big, "år text går vidare"), (1, 1, 2, *small, "Andra rubriken"), (1, 1, 3, *big, rest),
        *[(2, 0, i, *small, f"Innehåll {i} rubrik") for i in range(9)], (2, 1, 0, *big, "kort"),
    ]
    rows = [(f, page, block, line, 0, font, size, 0, text) for f in ("a.pdf", "b.pdf") for page, block, line, font, size, text in lines]
    spans = spark.createDataFrame(rows, P.SPANS)
    found = P.sections(spans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("page" in k for k in keys)  # neither lines nor pages are a shuffle of their own
    assert plan.count("collect_list(struct(span") <= 2  # lines are made once, partly and wholly, not again for drop caps
    want = [("Rubrik ett", 1, "början av text som är lång\n\nVår text går vidare"), ("Andra rubriken", 1, rest)]
    for f in ("a.pdf", "b.pdf"):
        assert [(r.heading, r.page, r.text) for r in sorted(found.collect(), key=lambda r: r.nth) if r.file == f] == want
