"""What queries keep on disk while they run."""

import os
import random
from urllib.parse import unquote

from cladeframe.llm import html


def test_texts_of_pages_are_kept_compressed(spark):
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=1500)) for _ in range(60)]
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<html><body><article><p>{t}</p></article></body></html>")
                                   for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    found = html.main_text(pages)
    assert {r.page_id: r.text for r in found.collect()} == dict(enumerate(texts))
    kept = sum(os.path.getsize(unquote(f).removeprefix("file://")) for f in found.inputFiles())
    assert kept < 0.6 * sum(map(len, texts))
