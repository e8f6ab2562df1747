"""Rows whose categories are NULL or outside the hierarchy stay, and plans for small and large inputs agree."""

import harness
import pytest

from veilspark.operators import semantic_noise as sn
from veilspark.operators.marginality import marginality_sample
from veilspark.operators.release import microdp
from veilspark.plans import fixtures as fx

SF = f"{harness.DATA}/sf0.001"


@pytest.fixture(scope="module")
def blank(spark):
    return fx.blank_customer_qi(spark, SF)


@pytest.mark.parametrize("strategy", ["ordered", "batched"])
def test_release_keeps_every_row(spark, blank, strategy):
    out = microdp(blank, fx.customer_qis(spark, SF), 1.0, 5, "s", strategy).collect()
    assert len({r["rid"] for r in out}) == len(out) == blank.count()
    assert all(r["nation"] is not None for r in out)


def test_cluster_without_known_value(spark):
    df = fx.customer_qi(spark, SF).limit(40).selectExpr("rid", "segment", "'NOWHERE' AS nation", "acctbal")
    known = {r[0] for r in fx.nation_lines(spark, SF).selectExpr("split(line, ';')[0]").collect()}
    out = microdp(df, fx.customer_qis(spark, SF), 1.0, 5, "s", "ordered").collect()
    assert len(out) == 40 and {r["nation"] for r in out} <= known


@pytest.mark.parametrize("noise", [sn.marginality_noise, sn.semantic_noise])
def test_noise_keeps_every_row(spark, blank, noise):
    tax = fx.taxonomy(spark, SF, "nation")
    out = noise(blank, "nation", tax, 0.5, "s").collect()
    assert len(out) == blank.count()
    assert all((r["noisy"] == "*") == (r["nation"] in (None, "NOWHERE")) for r in out)
    gone = blank.selectExpr("rid", "CAST(NULL AS STRING) AS nation")
    assert {r["noisy"] for r in noise(gone, "nation", tax, 0.5, "s").collect()} == {"*"}


def test_both_plans_of_the_nearest_value_agree(spark):
    df, tax = fx.customer_qi(spark, SF), fx.taxonomy(spark, SF, "nation")
    margins = marginality_sample(df, "nation", tax, targets="leaves")
    targets = df.selectExpr("rid", "CASE WHEN rid % 9 > 0 THEN 80 + acctbal / 1000 END AS target")
    plans = [{r["rid"]: r["nearest"] for r in sn.nearest_by_marginality(targets, "target", margins, rows=n).collect()}
             for n in (0, 10**9)]
    assert plans[0] == plans[1] and None in plans[0].values()
