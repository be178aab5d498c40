"""Pages with very many siblings: time and memory of the matching, and slots that repeated siblings share."""

import time
import tracemalloc

import pytest

from framequarry.llm import html_extract


def table(rows, other=""):
    return "<html><body><h1>t</h1><table>" + "".join(f"<tr><td><b>{i}</b></td><td><i>{other if i % 3 else ''}{i * 7}</i>{'<u>x</u>' if i % 5 == 0 else ''}</td></tr>" for i in range(rows)) + "</table><p>end</p></body></html>"


def thread(posts):
    """Posts of different shapes in nested lists, with tags that nobody else uses between them."""
    return "<body>" + "".join(f"<div><x{i % 700}>a</x{i % 700}><ul>{'<li>b<em>c</em></li>' * (i % 9)}</ul></div><y{i}></y{i}>" for i in range(posts)) + "</body>"


def matched(ref, page):
    shapes = {}
    a, b = html_extract.parse(ref), html_extract.parse(page)
    html_extract.number(a, shapes, slots=True)
    html_extract.number(b, shapes)
    html_extract.align(a, b)
    out, todo = [], [b]
    while todo:
        n = todo.pop()
        out.append((n.tag, n.slot))
        todo.extend(html_extract.elements(n))
    return out


@pytest.mark.parametrize("make, n", [(table, 5000), (thread, 3000)])
def test_long_pages_take_little(make, n):
    ref, page = make(n), make(n + 17)
    tracemalloc.start()
    began = time.process_time()
    found = matched(ref, page)
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 30 and most < 200e6  # traced, which is several times slower
    assert sum(slot >= 0 for _, slot in found) > 0.98 * len(found)


def test_repeated_rows_share_slots(monkeypatch):
    found = [slot for tag, slot in matched(table(200), table(300, "z")) if tag == "tr"]
    assert len(found) == 300 and len(set(found)) == 2  # a slot for each of two shapes
    few = [slot for tag, slot in matched(table(20), table(20)) if tag == "tr"]
    assert len(set(few)) == 20


def test_long_tables_come_through_whole(spark):
    """Rows of long tables stay in the text, in order; a long menu that all pages of the host have goes."""
    menu = "<div>" + "".join(f"<p><a>item {i}</a></p>" for i in range(120)) + "</div>"
    pages = [(k, f"http://h.example/{k}", f"<body>{menu}<div><h2>head {k}</h2>" + "".join(f"<p>row {k} {i} of the page</p>" for i in range(300 + k)) + "</div></body>") for k in range(7)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(7):
        assert got[k] == "\n".join([f"head {k}", *[f"row {k} {i} of the page" for i in range(300 + k)]])
