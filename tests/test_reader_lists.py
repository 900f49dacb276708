"""Lists by common readers take all items with enough readers, whatever else is known of them."""

import pytest

from tidemark.plans import modelling as P
from tidemark.plans.queries import ORACLE
from tidemark.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("least", [5, 25])
def test_items_of_any_size_are_listed(spark, least):
    small = table(spark, FOLDER, "part").where("p_size < 15").selectExpr("p_partkey as item_id")
    assert P.cf_best(spark, FOLDER, least).join(small, "item_id", "left_semi").count() > 0


@pytest.mark.parametrize("name", ["cf_recommend", "cf_recommend_supported", "recommend_by_title"])
def test_the_twins_take_no_part_away(name):
    assert "FROM readers SEMI JOIN" not in ORACLE[name]
