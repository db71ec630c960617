"""Explorer: filters, untrimmed search, paging and card fields."""

from pyspark.sql import functions as F

from reviewlens.functions import display
from reviewlens.operators import explore


def _reviews(spark):
    rows = [("p", i, f"user{i % 3}", (i % 5) + 1, f"text number {i} about trading lag" if i % 4 == 0 else f"plain {i}",
             f"2026-06-{(i % 28) + 1:02d}T00:00:00", i * 37 % 11, "9.1" if i % 2 else "18.0") for i in range(35)]
    return spark.createDataFrame(rows, "product string, seq long, author string, rating int, text string, "
                                       "timestamp string, thumbs_up int, app_version string")


def test_pages_concatenate_to_full_sort(spark):
    df = _reviews(spark)
    pages = []
    for p in (1, 2, 3, 4):
        pages += [r.seq for r in explore.explore_page(df, sort="newest", page=p).orderBy("position").collect()]
    full = [r.seq for r in df.orderBy(*explore.sort_order("newest")).collect()]
    assert pages == full
    counts = explore.explore_counts(df).first()
    assert counts.filtered == 35 and counts.pages == 4


def test_filters_and_untrimmed_search(spark):
    df = _reviews(spark)
    assert df.filter(explore.filters(stars=(1, 2))).count() == 14
    assert df.filter(explore.filters(version="9.1")).count() == 17
    # the trimmed query decides activity, the untrimmed one is matched
    assert df.filter(explore.filters(search=" lag")).count() == 9
    assert df.filter(explore.filters(search="   ")).count() == 35
    assert df.filter(explore.filters(search="USER1")).count() == 12
    assert explore.toggle_star(frozenset({5}), 5) == frozenset() and explore.toggle_star(frozenset(), 4) == {4}


def test_versions_string_order(spark):
    got = [r.app_version for r in explore.versions(_reviews(spark)).collect()]
    assert got == ["9.1", "18.0"]


def test_cards_and_tags(spark):
    df = spark.createDataFrame([
        ("", 1, "order stuck again", 1500, "2026-06-09T00:00:00"),
        ("bob", 5, "love this address book", 3, "bad"),
        ("amy", 3, "nothing matches here", 0, "2026-06-09T00:00:00"),
        ("cy", 2, "please call support", 5, "2026-06-09T00:00:00"),
    ], "author string, rating int, text string, thumbs_up int, timestamp string")
    name, color = display.theme_tag()
    out = df.select(display.sentiment().alias("s"), display.suggested_action().alias("a"),
                    display.abbreviate_count().alias("t"), display.author_initial().alias("i"),
                    display.display_date(F.try_to_timestamp("timestamp")).alias("d"),
                    name.alias("n"), color.alias("c")).collect()
    assert [r.s for r in out] == ["neg", "pos", "neu", "neg"]
    assert [r.a for r in out] == ["Escalate", "Thank User", "Reply", "Escalate"]
    assert out[0].t == "1.5K" and out[1].t == "3" and out[0].i == "?" and out[1].i == "B"
    assert out[0].d == "9 Jun 2026" and out[1].d == "Invalid Date"
    # first match wins; "address" hits "add" (substring, no word boundary)
    assert [r.n for r in out] == ["Trading Issues", "Feature Requests", "Feature Requests", "Poor Customer Support"]
    assert out[1].c == "amber"
