import random
import string

from compindex.llm import secrets

FILLER = ["market garden window river", "yellow street letter border", "winter morning signal paper"]


def key(rng):
    """A base62 key with at least two letter runs of four or more and enough digits."""
    runs = ["".join(rng.choices(string.ascii_letters, k=9)) for _ in range(3)]
    return "".join(f"{r}{rng.randint(10, 99)}" for r in runs)


def test_key_in_copies_is_not_its_own_dictionary(spark):
    rng = random.Random(4)
    leaked = key(rng)
    rows = [(i, f'{FILLER[i % 3]} note{"abc"[i % 3]} token = "{key(rng)}" end') for i in range(30)]
    rows += [(100 + i, f'{FILLER[i % 3]} mail name{i}.some{i}@market{i}.garden.com') for i in range(30)]
    rows += [(200 + i, f'copied words token = "{leaked}" end') for i in range(8)]
    rows += [(300 + i, f'other words {i} token = "{leaked}" end') for i in range(4)]  # also in unequal texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not {r["part"] for r in secrets.dictionary(docs).collect()} & {"copied", leaked[:9].lower()}
    found = {r["doc_id"] for r in secrets.scan(docs).collect() if r["is_secret"]}
    assert found >= {*range(200, 208), *range(300, 304)} and not found & set(range(100, 130))


def test_any_value_of_a_credential_name_is_a_candidate(spark):
    texts = [
        'password: "hunter2!" x', 'secret = "correct-horse-battery"', "pwd=ab#1", "Authorization: Bearer q~7&", "token 'z9'", 'api_key="p%w*long1234567890"',
        "the author wrote this", "password:", "plain words", 'password = ""',
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["value"]) for r in secrets.candidates(docs).collect())
    assert [g for g in got if g[0] not in (3,)] == [(0, "hunter2!"), (1, "correct-horse-battery"), (2, "ab#1"), (4, "z9"), (5, "p%w*long1234567890")]
    assert (3, "q~7&") in got
