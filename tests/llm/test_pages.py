"""op3 on pages that its training writer did not make."""

import os
import sys
from collections import Counter

import pytest

from millrace.llm import extract

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pages_by_hand import PAGES, page_of, text_of  # noqa: E402


@pytest.fixture(scope="module")
def found():
    model = extract.trained()
    return {name: (model.main_text(page_of(s)), text_of(s)) for name, s in PAGES.items()}


def test_pages_by_hand(found):
    assert len(found) >= 30
    lost = kept = total = 0
    for got, want in found.values():
        a, b = Counter(got.split()), Counter(want.split())
        lost += sum(len(w) * n for w, n in (b - a).items())
        kept += sum(len(w) * n for w, n in (a - b).items())
        total += sum(map(len, want.split()))
    assert lost / total < 0.05 and kept / total < 0.02


@pytest.mark.parametrize("name", ["bare body", "details in article", "details and table", "fieldset in article", "responses", "responses outside", "unnamed wrappers", "adverts between", "one paragraph"])
def test_layouts_that_must_be_whole(found, name):
    got, want = found[name]
    assert got == want


def test_a_very_long_page_keeps_every_block(spark):
    blocks = [f"Paragraph {k} goes on with the tale, and then it ends." for k in range(20_000)]
    page = "<body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article><footer>Site</footer></body>"
    df = spark.createDataFrame([(1, "u", page, 7)], "page_id long, url string, html string, n_chars long")
    got = extract.extract_pages(df, extract.trained()).first()
    assert got.text == " ".join(blocks) and got.n_chars == len(got.text)
