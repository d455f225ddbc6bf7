"""Values that other words, times or short parts touch."""

from wordloom.llm import pii

VALUES = ["ES91 2100 0418 4502 0005 1332", "BE68539007547034", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
AFTER = [" for rent", " and", " with this that", " a", ", ok", "", " 12"]


def test_ibans_before_words():
    there, back = pii.Pseudonymizer(b"k"), pii.Pseudonymizer(b"k", inverse=True)
    for value in VALUES:
        for after in AFTER:
            text = f"pay {value}{after}"
            new, spans = there.text(text)
            assert spans == [(4, 4 + len(value), "iban")] and value not in new and new.endswith(after)
            assert back.text(new)[0] == text


def test_dates_of_other_forms():
    there, back = pii.Pseudonymizer(b"k"), pii.Pseudonymizer(b"k", inverse=True)
    for value in ["3/5/1984", "03/5/1984", "3.25.1984", "25-3-1984", "1984-3-5", "1984/11/5", "12/9/2001"]:
        new, spans = there.text(f"on {value}, so")
        assert [k for *_, k in spans] == ["date"] and value not in new and back.text(new)[0] == f"on {value}, so"
        assert [len(x) for x in new.replace(",", " ").split()] == [len(x) for x in f"on {value}, so".replace(",", " ").split()]
    for text in ["1984-03-05T00:00:00Z", "at 1984-03-05T00:00:00.5+01:00.", "1984-03-05T12"]:
        new, spans = there.text(text)
        assert [k for *_, k in spans] == ["date"] and "1984-03-05" not in new and back.text(new)[0] == text
        assert new[new.index("T") :] == text[text.index("T") :]
    for text in ["1/2/3", "13/45/1984", "1984-03-05Tx", "1984-13-1", "v1.2.19841", "3/5/198"]:
        assert there.text(text) == (text, [])
