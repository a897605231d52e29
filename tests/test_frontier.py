"""Rounds of new links: each once, at most so many a seed, reading only the ranges they fall in."""

import pytest

from martlet.sources import frontier, links


def found(spark, rows):
    return spark.createDataFrame(rows, "seed string, link string")


@pytest.mark.parametrize("cuts", [1, 4, 256])
def test_every_link_once_and_capped_by_seed(spark, tmp_path, cuts):
    rows = [(f"s{k % 5}", f"https://x/{'abcdefg'[k % 7]}/{k % 40:03d}") for k in range(400)] + [("s1", None), ("s0", "https://x/a/000")]
    owner = {}
    for seed, link in rows:
        if link:
            owner[link] = min(seed, owner.get(link, seed))
    wanted, root = [], str(tmp_path)
    left = sorted(owner, key=lambda x: (owner[x], x))
    for number in range(1, 30):
        taken = [x for x in left if sum(owner[y] == owner[x] for y in left[:left.index(x)]) < 6]
        got = {(r["link"], r["seed"], r["round"]) for r in frontier.advance(found(spark, rows), root, "2024-01-01", 6, cuts).collect()}
        assert got == {(x, owner[x], number) for x in taken}
        left = [x for x in left if x not in taken]
        wanted += taken
        if not taken:
            break
    everything = [r["link"] for r in frontier.seen(spark, root).collect()]
    assert sorted(everything) == sorted(wanted) == sorted(owner)


def test_new_links_meet_their_ranges_only(spark, tmp_path):
    root = str(tmp_path)
    frontier.advance(found(spark, [("s", f"https://x/{k:04d}") for k in range(500)]), root, "2024-01-01", n_cuts=16)
    assert frontier.advance(found(spark, [("s", "https://x/0007"), ("s", "https://x/0007a")]), root, "2024-01-02").select("link").collect() == [("https://x/0007a",)]
    cuts = [r["cut"] for r in frontier.seen(spark, root).where("link >= 'https://x/0007' AND link <= 'https://x/0007a'").select("cut").distinct().collect()]
    plan = frontier.seen(spark, root, cuts)._jdf.queryExecution().executedPlan().toString()
    assert len(cuts) <= 2 and "PartitionFilters: [cut" in plan.replace("isnotnull(", "")
    assert frontier.advance(found(spark, []), root, "2024-01-03").count() == 0


def test_product_links_of_pages(spark):
    page = '<a href="/laptop/gaming-laptop-i7-16gb-ssd-{}/x">a</a> <a class=b href=\'/about\'>c</a> <a href="/laptop/gaming-laptop-i7-16gb-ssd-{}/x">'
    pages = spark.createDataFrame([(f"u{k}", page.format(k, k // 2)) for k in range(6)] + [("v", None)], "url string, html string")
    got = sorted(r["link"] for r in links.product_links(pages).collect())
    assert len(got) == 6 and got[0].endswith("/laptop/gaming-laptop-i7-16gb-ssd-0/x")
    assert [r["link"] for r in links.product_links(pages, max_products=2).collect()] == got[:2]
