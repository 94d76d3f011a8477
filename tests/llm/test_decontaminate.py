"""Edit matching against a plain dynamic program."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actilens.llm import decontaminate
from tests.llm.conftest import prose


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def plain_normal(text):
    return " " + re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip(" ") + " "


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=18), st.text(alphabet="abc ", max_size=40))
def test_bit_parallel_distance(item, text):
    masks = {}
    for bit, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << bit
    got, want = decontaminate.myers(item, masks, text, len(item)), plain_distance(item, text)
    assert (got[0] if got else len(item)) == want


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        match rng.randrange(3):
            case 0:
                letters[at] = "x"
            case 1:
                letters.insert(at, "x")
            case _:
                del letters[at]
    return "".join(letters)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, 30, 2000)) for k in range(6)] + [(6, "tiny text"), (7, None), (8, ""), (9, " --- "), (None, prose(rng, 25, 2000)), (0, "other")]
    docs = [(k, prose(rng, 80, 2000)) for k in range(20)]
    n = 100
    for item, text in items[:6] + items[10:11]:
        for edits in (0, 1, 4, 9, 14, 40):
            docs.append((n, f"{prose(rng, 30)}. {edited(rng, text, edits)}! {prose(rng, 30)}"))
            n += 1
        docs.append((n, text.upper().replace(" ", " ,\n")))
        n += 1
    docs += [(500, "a tiny, TEXT here"), (501, "a tinytext here"), (502, "shiny text"), (503, None), (504, ""), (505, "tiny text"), (505, "tiny text"), (None, "tiny text")]
    return items, docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_matches_are_those_of_the_plain_version(planted):
    items, docs, doc_frame, item_frame = planted
    want = []
    for doc, text in docs:
        for item, passage in items:
            plain = plain_normal(passage).strip(" ")
            errors = int(len(plain) * decontaminate.ERROR_SHARE)
            normal = plain_normal(text)
            if not plain:
                continue
            d = plain_distance(plain, normal)
            if d <= errors and (errors or f" {plain} " in normal):
                want.append((doc, item, d, errors))
    got = [(r.doc_id, r.item_id, r.distance, r.budget) for r in decontaminate.matches(doc_frame, item_frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 30
    small = decontaminate.matches(doc_frame, item_frame, block_bytes=300).collect()  # many blocks, same rows
    assert sorted(((r.doc_id, r.item_id, r.distance, r.budget) for r in small), key=str) == sorted(want, key=str)


def test_clean_keeps_the_rest(planted):
    items, docs, doc_frame, item_frame = planted
    hit = {(r.doc_id) for r in decontaminate.matches(doc_frame, item_frame).collect()}
    kept = decontaminate.clean(doc_frame, item_frame).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)


def test_messy_and_empty_tables(spark, messy, messy_rows, no_docs):
    items = spark.createDataFrame([(1, None), (2, "word")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(messy, items).collect()} == {4, 5}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(messy, none).count() == 0
    kept = decontaminate.clean(messy, none)
    assert kept.schema == messy.schema and kept.count() == len(messy_rows)
    assert decontaminate.matches(no_docs, items).count() == 0 and decontaminate.clean(no_docs, items).count() == 0
