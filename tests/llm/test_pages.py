"""Site templates: counts against plain Python, planted footers, article paragraphs, odd markup."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slowlens.llm import pages

FOOTER = "<div class='x7'><p>All prices include tax.</p><p>Imprint and terms</p></div>"
NOTICE = "<p>Our office is closed on Mondays.</p>"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def site(host="big.example", n=200, share=0.25, article=False):
    """Pages of one host: own paragraphs, on a share of them a plain footer, on some a notice, and near copies of one page."""
    r, rows, own = random.Random(7), [], {}
    opened, closed = ("<article>", "</article>") if article else ("", "")
    copied = [words(10_000 + j, 30) for j in range(4)]
    for i in range(n):
        paragraphs = [words(1_000 * i + j, r.randint(5, 40)) for j in range(r.randint(1, 5))]
        if i % 10 == 0:  # near copies: the same paragraphs but for one
            paragraphs = [*copied, words(i, 3)]
        own[i] = paragraphs
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        footer = FOOTER if r.random() < share else ""
        notice = NOTICE if r.random() < share else ""
        rows.append((i, f"https://{host}/p/{i}", f"<html><body>{notice}{opened}{body}{closed}{footer}</body></html>"))
    return rows, own


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


@pytest.mark.parametrize("share", [0.2, 0.4, 0.9])
def test_plain_templates_are_deleted_and_articles_stay(spark, share):
    rows, own = site(share=share)
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(frame(spark, rows)).collect()}
    assert got == {i: "\n\n".join(p) for i, p in own.items()}
    kept = {r["page_id"]: r["text"] for r in pages.extract_pages(frame(spark, rows), least_pages=10**6).collect()}
    assert sum(got[i] != kept[i] for i in got) >= 0.5 * share * len(rows)  # counting is what does it


def test_recurring_sentences_of_articles_stay(spark):
    rows, own = site(article=True, share=0.4)
    line = "<p>A sentence that many articles begin with.</p>"
    rows = [(i, u, h.replace("<article>", "<article>" + line) if i % 3 == 0 else h) for i, u, h in rows]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(frame(spark, rows)).collect()}
    first = "A sentence that many articles begin with."
    assert got == {i: "\n\n".join([first, *p] if i % 3 == 0 else p) for i, p in own.items()}
    most = [(i, u, h.replace("<article>", "<article>" + line)) for i, u, h in site(article=True)[0]]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(frame(spark, most)).collect()}
    assert not any(first in t for t in got.values())


def test_counts_equal_plain_counts(spark):
    rows = site("a.example", 60, 0.5)[0] + site("b.example", 9, 0.9, True)[0] + site("c.example", 5, 1.0)[0]
    rows += rows[:7] + [(900, None, "<p>x</p>"), (901, "", "<p>x</p>"), (902, "http://a.example/", None), (903, "http://A.example:80/", "")]
    found = {r["host"]: (set(r["frequent"]), set(r["inside"])) for r in pages.site_templates(frame(spark, rows)).collect()}
    beside, different = defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        if not url or page is None:
            continue
        host = url.split("//")[1].split("/")[0].split(":")[0].lower()
        different[host].add(page)
        for subtree, inside, core in pages.subtree_cores(pages.tree_of(page)):
            beside[host, subtree, inside].add(core)
    wanted = defaultdict(lambda: (set(), set()))
    for (host, subtree, inside), cores in beside.items():
        n = len(different[host])
        needed = max(8, -(-(4 * n) ** 0.5 // 1))
        if inside:
            needed = max(needed, n / 2)
        if n >= 8 and len(cores) >= needed:
            wanted[host][inside].add(subtree)
    assert found == dict(wanted) and found


def test_copies_of_a_page_count_once(spark):
    page = "<body><p>One article, copied.</p><p>With two paragraphs of some length.</p></body>"
    rows = [(i, f"http://h.example/{i}", page.replace("copied", f"copied{i % 2}")) for i in range(60)]
    rows += [(100 + i, f"http://h.example/x{i}", f"<p>{words(i, 9)}</p>") for i in range(20)]
    got = [r["text"] for r in pages.extract_pages(frame(spark, rows)).where(F.col("page_id") < 60).collect()]
    assert set(got) == {f"One article, copied{k}.\n\nWith two paragraphs of some length." for k in (0, 1)}


def test_a_subtree_is_not_its_own_neighbour():
    root = pages.tree_of("<body><div><p>The longest block of this page</p></div><p>short</p></body>")
    cores = {c for _, _, c in pages.subtree_cores(root)}
    hashes = set(pages.hash_subtrees(root).values())
    assert len(cores) == 2 and cores < hashes


def test_cores_of_deep_and_long_pages():
    deep = "<div>" * 3000 + "".join(f"<p>{words(i, 4)}</p>" for i in range(3000)) + "</div>" * 3000
    cores = pages.subtree_cores(pages.tree_of(deep))
    assert len(cores) > 5000

    def plain(root):
        """By the definition: the longest block that is not below any element of the hash."""
        hashes, blocks, places, stack = pages.hash_subtrees(root), [], set(), [(root, (), False)]
        while stack:
            e, above, inside = stack.pop()
            if id(e) in hashes:
                above = (*above, hashes[id(e)])
                places.add((hashes[id(e)], inside))
                own = sum(len(c.strip()) for c in e.children if isinstance(c, str))
                if own:
                    blocks.append((-own, hashes[id(e)], above))
            inside = inside or e.tag in ("article", "main")
            stack.extend((c, above, inside) for c in e.children if isinstance(c, pages.Element))
        return {(s, i, min(((n, h) for n, h, above in blocks if s not in above), default=(0, 0))[1]) for s, i in places}

    r = random.Random(3)
    for _ in range(40):
        page = "".join(r.choice(["<div>", "</div>", "<article>", "</article>", f"<p>{words(r.randrange(6), 3)}</p>", words(r.randrange(3), 2)]) for _ in range(40))
        root = pages.tree_of(page)
        assert pages.subtree_cores(root) == plain(root)
