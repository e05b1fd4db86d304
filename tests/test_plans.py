"""What plans must look like: filters and columns reach the scan, top-k isn't a full sort, range joins aren't loops."""

import contextlib
import io
import re

from millrace.registry import QUERIES


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["filter_project"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_discount,0.05)" in text and "LessThan(l_quantity,24.0)" in text
    assert "l_comment" not in text and "l_tax" not in text


def test_top_k_is_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k_offset"](spark, sf_dir)).replace("GlobalLimit", "")


def test_top_k_of_groups_is_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["top_k_per_group"](spark, sf_dir))


def test_range_join_is_no_loop(spark, sf_dir):
    text = plan(QUERIES["join_range"](spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_asof_join_shuffles_once(spark, sf_dir):
    assert len(re.findall(r"^\(\d+\) Exchange", plan(QUERIES["join_asof"](spark, sf_dir)), re.M)) == 1
