"""What trusted contexts find beyond single words."""

from hemtally.llm import pii


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in pii.personal_data(rows).collect()}
    return [[(pii.KINDS[k], texts[i][a:b]) for a, k, b in got[i]] for i in range(len(texts))]


def test_spaced_numbers_are_found_whole(spark):
    phones = [f"please call me on +1 (706) 555-31{i} today" for i in range(10, 34)]
    cards = [f"charge the card 4111 1111 1111 {x} now" for x in ("1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194")]
    wanted = {
        "please call me on (706) 555-3138 today": [("phone", "(706) 555-3138")],
        "please call me on 706 555 3138 today": [("phone", "706 555 3138")],
        "please call me on 706 - 555 - 3138 today": [("phone", "706 - 555 - 3138")],
        "please call me on 706.555.3138 today": [("phone", "706.555.3138")],
        "charge the card 4111 1111 1111 1112 now": [("card", "4111 1111 1111 1112")],
        "charge the card 2020 4111111111111112 now": [("card", "4111111111111112")],
        "nothing like 706 555 3138 here": [],
        "1 2 3 " * 5000: [],
        "7 " * 5000 + "apples": [],
    }
    got = found(spark, [*phones, *cards, *wanted])
    assert not any(got[: len(phones) + len(cards)])
    assert got[len(phones) + len(cards) :] == list(wanted.values())


def test_contexts_are_words_however_long(spark):
    long = "x" * 70
    known = [f"note the {long}a {long}b u{i}@mail.example.com {long}c" for i in range(12)]
    texts = [f"note the {long}a {long}b hidden@intranet {long}c", f"{long}d    {long}e{' ' * 70}hidden2@intranet {long}f", f"{' ' * 70}hidden3@intranet{' ' * 50}z"]
    got = found(spark, [*known, *texts])
    assert got[12:] == [[("email", "hidden@intranet")], [], []] and not any(got[:12])
