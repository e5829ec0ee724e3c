"""Personal data is found beside other digits, words and marks."""

from chainloom.llm import pii

CASES = [
    ("4111 1111 1111 1111 12/26", "4111 1111 1111 1111"),
    ("4111111111111111 123", "4111111111111111"),
    ("no 3 4111111111111111", "4111111111111111"),
    ("4111-1111-1111-1111 078-05-1120", "4111-1111-1111-1111"),
    ("4111 1111 1111 1111 5500 0000 0000 0004", "5500 0000 0000 0004"),
    ("4111 1111 1111 1111 12x", "4111 1111 1111 1111"),
    ("DE89 3704 0044 0532 0130 00 VISA", "3704 0044 0532 0130 00"),
    ("GB82WEST12345698765432 BIC", "12345698765432"),
    ("-john@a.com", "john@"),
    ("_john@a.com", "john@"),
    ("...john@a.com", "john@"),
    ("j" * 70 + "@a.com", "j" * 70),
    ("call 743-555-3824.", "743-555-3824"),
    ("call 743.555.3824", "743.555.3824"),
    ("call 1-743-555-3824, 743 555 3824", "743 555 3824"),
    ("tel.743-555-3824 and 12", "743-555-3824"),
]
STAY = ["1234567812345678 123", "...@a.com", "1-2-743-555-3824-9", "DE88 3704 0044 0532 0130 00 VISA", "x4111111111111111", "41111111111111111111111"]


def test_values_beside_others_are_replaced(spark):
    rows = list(enumerate([t for t, _ in CASES] + STAY))
    got = {r.doc_id: r for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    kept = [(t, got[i].text) for i, (t, v) in enumerate(CASES) if v in got[i].text or len(got[i].text) != len(t)]
    assert kept == []
    assert [got[len(CASES) + i].text for i in range(len(STAY))] == STAY
    assert "078-05-1120" not in got[3].text and got[8].text[1:] == got[9].text[1:] == got[10].text[3:]
