"""op8's added kinds on texts that are not built from the operator's own lists."""

import random

import pytest

from timelode.llm import pii

PEOPLE = """Aaliyah Washington, Björn Åkesson, Priya Raghunathan, Kwame Mensah, Yusuf Demir, Siobhan Gallagher, Mateusz Kowalczyk, Ingrid Solberg, Tomás Herrera,
Chiara Bianchi, Dmitri Volkov, Leila Haddad, Owen Fitzgerald, Noor Rahman, Bridget Callahan, Hiroshi Tanaka""".replace("\n", " ").split(", ")
WORDS = "the house stood near old water and they went along a quiet road with some bread before evening came".split()


def iban(rng, land, n):
    """With check digits worked out by the rule of the standard."""
    body = "".join(rng.choice("0123456789") for _ in range(n))
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    whole = f"{land}{check:02d}{body}"
    return rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])


def example(rng, kind, true):
    """Text before, span or decoy, text after."""
    person, digits = rng.choice(PEOPLE), lambda lo, hi: str(rng.randint(lo, hi))
    number = f"{digits(100, 665)}-{digits(10, 99)}-{digits(1000, 9999)}"
    phone = f"({rng.choice(['415', '212', '646', '303'])}) {digits(200, 899)}-{digits(1000, 9999)}"
    account = iban(rng, *rng.choice([("DE", 18), ("AT", 16), ("ES", 20)]))
    good = {
        "name": [("Sincerely, ", person, ""), ("Best regards,\n", person, ""), ("Hello, my name is ", person, " and"), ("the patient ", person, " was seen"), ("please contact ", person, " for"), ("signed by ", "Dr. " + person, ""), ("a letter from ", "Mrs " + person.split()[1], " came")],
        "iban": [("IBAN ", account, ""), ("transfer it to ", account, " today"), ("my account: ", account, "")],
        "id_number": [("SSN ", number, ""), ("social security no. ", number, ""), ("he gave ", number, " as his")],
        "local_phone": [("call ", phone, " now"), ("reach us at ", phone, ""), ("phone: ", phone, "")],
    }
    decoys = {
        "name": [("they crossed the ", "Golden Gate", " bridge"), ("a course in ", "Deep Learning", " began"), ("near the ", "Great Barrier Reef", ""), ("he read ", "Pride And Prejudice", ""), ("on ", "Monday Morning", " it"), ("in ", "New York", " again")],
        "iban": [("order ", "DE12 3456 7890 1234 5678 90", ""), ("serial ", "AB12CD34EF56GH78", ""), ("model ", "XX00 1111 2222 3333", "")],
        "id_number": [("part serial ", f"9{digits(10, 99)}-00-{digits(1000, 9999)}", ""), ("invoice ", f"000-12-{digits(1000, 9999)}", "")],
        "local_phone": [("order ref ", f"{rng.choice(['011', '199', '100'])}-{digits(100, 199)}-{digits(1000, 9999)}", ""), ("isbn ", f"100.{digits(100, 199)}.{digits(1000, 9999)}", "")],
    }
    return rng.choice((good if true else decoys)[kind])


@pytest.mark.parametrize("seed", [5, 6])
def test_precision_and_recall_of_each_added_kind(spark, seed):
    rng, rows, true = random.Random(seed), [], set()
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    for i in range(1500):
        kind, planted = rng.choice(pii.MORE_KINDS), rng.random() < 0.5
        before, span, after = example(rng, kind, planted)
        before = prose() + rng.choice([" ", ". "]) + before
        rows.append((i, before + span + after + " " + prose()))
        if planted:
            true.add((i, f"{kind}:{len(before)}:{len(before) + len(span)}"))
    got = {(r.doc_id, s) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans.split(",") if s.split(":")[0] in pii.MORE_KINDS}
    for kind in pii.MORE_KINDS:
        own, want = ({x for x in found if x[1].startswith(kind + ":")} for found in (got, true))
        right = len(own & want)
        assert right >= 0.9 * len(own) and right >= 0.9 * len(want), (kind, right, len(own), len(want))
