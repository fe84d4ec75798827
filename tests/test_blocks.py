"""Nested blocks against a reader that goes through the lines with a stack."""

import random
import re

from pyspark.sql import functions as F

from terrafold.operators import blocks


def read(text):
    """Lines with each opener matched to its closer by a stack of all that is open."""
    lines, stack, pairs = re.split(r"\r?\n", text), [], {}
    for k, line in enumerate(lines):
        if re.match(r":::\w", line.strip(), re.A):
            stack.append(k)
        elif line.strip() == ":::" and stack:
            pairs[stack.pop()] = k
    out = list(lines)
    for a, b in pairs.items():
        if found := re.match(r":::(details|note|warning)", lines[a]):
            title = re.match(r":::(?:details|note|warning)\s+(.+)", lines[a], re.A)
            name = title[1].strip() if title else found[1].upper()
            out[a] = (f'<details class="details">' if found[1] == "details" else f'<div class="box {found[1]}">') + f"\n<summary>{name}</summary>" + ("\n" if b == a + 1 else "")
            out[b] = ("</details>" if found[1] == "details" else "</div>") + "\n"
    return "\n".join(out)


def told(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("edits_", F.lit(1)).repartition(3)
    return [r.html for r in sorted(blocks.with_blocks(rows, "text", "html").collect(), key=lambda r: r.k)]


def test_known_texts(spark):
    note = lambda title, body: f'<div class="box note">\n<summary>{title}</summary>\n{body}\n</div>\n'
    cases = {
        ":::note  a b \nx\n:::": note("a b", "x"),
        "t\n:::note\n:::details  d\ny\n  :::  \n:::\nz": "t\n" + note("NOTE", '<details class="details">\n<summary>d</summary>\ny\n</details>\n') + "\nz",
        ":::note\nnever closed": ":::note\nnever closed",
        ":::note\n:::other\n:::": ":::note\n:::other\n:::",
        ":::note\n:::other\n:::\n:::": note("NOTE", ":::other\n:::"),
        " :::note\nx\n:::": " :::note\nx\n:::",
        ":::\n:::note\r\n:::\n:::": ":::\n" + note("NOTE", "") + "\n:::",
        ":::note\n\n:::": note("NOTE", ""),
        "a\r\nb": "a\nb",
        "": "",
    }
    assert told(spark, [*cases, None]) == [*cases.values(), None]


def test_random_texts(spark):
    some = random.Random(3)
    pieces = [":::note t", ":::details", ":::warning  w w ", ":::", " ::: ", " :::note", ":::x", "::::", "::: ", "x", "", ":::notes"]
    texts = ["\n".join(some.choice(pieces) for _ in range(some.randrange(1, 16))) for _ in range(1500)]
    assert told(spark, texts + texts[:200]) == [read(t) for t in texts + texts[:200]]


def test_deep_and_long_texts(spark):
    deep = "\n".join([":::note"] * 3000 + ["x"] + [":::"] * 3000)
    wide = "\n".join(":::note\nx\n:::" for _ in range(3000))
    assert told(spark, [deep, wide]) == [read(deep), read(wide)]
