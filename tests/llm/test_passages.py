"""Recurring passages of op9_line_dedup: their share of a text and short lines do not save them."""

import random

from lexweave.llm.templates import without_recurring_lines


def said(rng, n):
    return " ".join(rng.choice("abcdefghij") + "".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n))


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["text"] for r in without_recurring_lines(docs).select("row.doc_id", "text").collect()}


def test_passage_over_half_of_a_text_goes(spark):
    rng = random.Random(1)
    passage = said(rng, 60)
    own = [said(rng, 50) for _ in range(6)]
    left = cleaned(spark, [f"{passage}\n{o}" for o in own])
    assert sum(passage in t for t in left.values()) == 1
    assert sorted(t.split("\n")[-1] for t in left.values()) == sorted(own)


def test_wrapped_passage_of_two_texts_goes(spark):
    rng = random.Random(2)
    wrapped = [said(rng, 5) for _ in range(12)]
    lone = said(rng, 5)
    texts = ["\n".join([said(rng, 40), *wrapped[:6], "", *wrapped[6:], said(rng, 40), lone, said(rng, 40)]) for _ in range(2)]
    left = cleaned(spark, texts)
    for line in wrapped:
        assert sum(line in t for t in left.values()) == 1
    # A short line of two texts on its own is no passage.
    assert all(lone in t for t in left.values())


def test_short_line_of_eight_texts_goes_whatever_its_cells(spark):
    """Eight texts nearly always share cells of a 64-cell counter; all of many such lines go."""
    rng = random.Random(3)
    shared = [said(rng, 5) for _ in range(12)]
    left = cleaned(spark, [f"{s}\n{said(rng, 30)}" for s in shared for _ in range(8)])
    for line in shared:
        assert sum(line in t for t in left.values()) == 1


def test_only_a_true_copy_stays_whole(spark):
    rng = random.Random(4)
    lines = [said(rng, 20) for _ in range(10)]
    copies = ["\n".join([*lines, said(rng, 3)]) for _ in range(2)]
    assert cleaned(spark, copies) == dict(enumerate(copies))
    # Lines that several texts keep, together more than half of one, are no copy.
    apart = [said(rng, 12) for _ in range(3)]
    mixed = "\n".join([*apart, said(rng, 30)])
    left = cleaned(spark, [*[f"{a}\n{said(rng, 200)}" for a in apart], mixed])
    for line in apart:
        assert sum(line in t for t in left.values()) == 1


def test_leaf_of_two_templates_and_a_stray(spark):
    """All lines share their first three tokens and their length; fields are words."""
    rng = random.Random(5)
    one = lambda: f"This page was seen by {said(rng, 1)} near the old harbour of {said(rng, 1)} today"
    two = lambda: f"This page was {said(rng, 1)} printed from our archive {said(rng, 1)} without further written notice"
    stray = "This page was " + said(rng, 10)
    made = [one() for _ in range(6)] + [two() for _ in range(6)] + [stray]
    assert {len(m.split()) for m in made} == {13}
    texts = [f"{m}\n{said(rng, 40)}" for m in made]
    left = cleaned(spark, texts)
    stays = [m for m, i in zip(made, range(13)) if m in left[i]]
    assert len([m for m in stays if "harbour" in m]) == 1
    assert len([m for m in stays if "archive" in m]) == 1
    assert stray in stays


def test_twelve_templates_of_a_leaf(spark):
    """Two worded fields each, all in one leaf: one copy of each template stays, of few copies and of many."""
    for copies, seed in ((6, 6), (40, 7)):
        rng = random.Random(seed)
        forms = [(said(rng, 4), said(rng, 4)) for _ in range(12)]
        made = [(f, f"This page was {a} {said(rng, 1)} {b} {said(rng, 1)}") for f, (a, b) in enumerate(forms) for _ in range(copies)]
        left = cleaned(spark, [f"{m}\n{said(rng, 40)}" for _, m in made])
        stays = [f for i, (f, m) in enumerate(made) if m in left[i]]
        assert sorted(stays) == list(range(12))


def test_strays_and_wide_forms_of_a_leaf_stay(spark):
    """Lines of one opening and length that differ in over a fifth of their places are no template, however many."""
    rng = random.Random(8)
    own = [f"This page was {said(rng, 10)}" for _ in range(30)]
    wide = [f"This page was kept {said(rng, 4)} by our old office here" for _ in range(30)]
    form = [f"This page was last seen {said(rng, 1)} on our old office shelf here" for _ in range(30)]
    left = cleaned(spark, [f"{m}\n{said(rng, 40)}" for m in own + wide + form])
    stays = [m for i, m in enumerate(own + wide + form) if m in left[i]]
    assert [m for m in stays if m not in form] == own + wide and sum(m in form for m in stays) == 1
