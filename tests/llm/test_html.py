"""Main text of pages: the best run against all runs, names that only state a feature, deep nesting, odd markup."""

import random
import time

import pytest

from spanforge.llm import html

BODY = " ".join(f"word{i}" for i in range(80))
NOISE = "<nav><ul><li><a href=/a>home</a><li><a href=/b>news</a></ul></nav>"


def test_best_run_against_all_runs():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 30))]
        top = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0.0)
        a, b = html.best_run(x)
        assert sum(x[a:b]) == pytest.approx(max(top, 0.0)) and (top > 0) == (b > a)


@pytest.mark.parametrize("frame", [
    '<main class="has-sidebar">{}</main>', '<article class="post comment-open">{}</article>', '<div class="content share-enabled">{}</div>', '<div class="sidebar-layout"><main><p>{}</p></main></div>',
    "<div>{}</div>", "<table><tr><td>{}</table>", '<div id="entry"><p>{}</div>', "<section><h1></h1><p>{}</section>",
])
def test_pages_of_many_frames(frame):
    page = f"<html><head><title>t</title></head><body>{NOISE}{frame.format(BODY)}<div class='comments'><p>{'bad ' * 60}</p></div><footer>f g</footer></body></html>"
    assert html.main_text(page) == BODY


def test_boilerplate_inside_and_after():
    ad = '<div class="ad-slot">buy now at once</div>'
    page = f"{NOISE}<article><p>{BODY}</p>{ad}<p>{BODY}</p><aside>see also</aside></article><div class=comments><article class=comment><p>{'so true ' * 50}</p></article><div class=content>{'me too ' * 30}</div></div>"
    assert html.main_text(page) == f"{BODY} {BODY}"
    assert html.main_text(f"{NOISE}<article><p>{BODY}</p>{ad}{ad}<p>the end</p></article><footer>f</footer>") == f"{BODY} the end"
    assert html.main_text(f"<article><p>a&amp;b &lt;c&gt; x<b>y</b>z<br>w</p><script>no()</script><!-- no --><p>{BODY}</p></article>").startswith("a&b <c> xyz w word0")


def test_deep_nesting_takes_linear_time():
    def seconds(n):
        start = time.perf_counter()
        html.main_text('<div class="a b">' * n + "x</b>" * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(32_000) < 40 * max(seconds(2000), 0.005)


def test_rows(spark):
    rows = [(0, "u", f"<p>{BODY}</p>", "old", 5), (0, "u", f"<p>{BODY}</p>", "old", 5), (None, None, None, None, None), (2, "v", "", "old", 1), (3, "w", "<p", "old", 1), (4, "w", "1 < 2 " + "x" * 2_000_000, "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, extra int")
    got = html.extract(pages).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, len(r.text)) for r in got) == [(-1, 0), (0, len(BODY)), (0, len(BODY)), (2, 0), (3, 0), (4, 2_000_006)]
    assert sorted(html.extract(pages).columns) == sorted(pages.columns) and html.extract(pages.limit(0)).count() == 0
