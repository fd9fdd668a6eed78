"""Compression bands on texts of megabytes and on other alphabets."""

import random
import string

import pyarrow.parquet as pq

from matchlens.llm.quality_rules import Bands, document_stats, one_byte_letters

CYRILLIC = str.maketrans(string.ascii_letters, "".join(chr(0x0430 + i) for i in range(26)) + "".join(chr(0x0410 + i) for i in range(26)))


def clean(lang, sf="sf0.1"):
    folder = f"/root/testdata/{sf}"
    good = {r["doc_id"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["quality"] == 1}
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    seen, out = set(), []
    for d in docs:
        start = (d["text"] or "")[:200]
        if d["lang"] == lang and d["doc_id"] in good and start not in seen and document_stats(d["text"], Bands())[-1]:
            seen.add(start)
            out.append(d["text"])
    return out


def kept(text):
    return document_stats(text, Bands())[-1]


def test_megabytes_of_clean_text_pass():
    for lang in ("de", "fr", "es", "en"):
        text = "\n".join(clean(lang))[:1_000_000]
        assert len(text) > 500_000 and kept(text)


def test_long_repetition_still_fails():
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(60)]
    assert not kept(" ".join(rng.choices([" ".join(rng.choices(words, k=4)) for _ in range(40)], k=60_000)))


def test_verdicts_do_not_depend_on_the_alphabet():
    texts = clean("en")
    assert all(kept(t.translate(CYRILLIC)) for t in texts)
    bad = " ".join(["error at line", "retry the job"] * 200)
    assert not kept(bad) and not kept(bad.translate(CYRILLIC))


def test_syllables_stay_as_they_are():
    rng = random.Random(5)
    text = " ".join("".join(chr(0xAC00 + 97 * rng.randrange(90)) for _ in range(rng.randint(2, 4))) for _ in range(80))
    assert one_byte_letters(text) == text.encode()
