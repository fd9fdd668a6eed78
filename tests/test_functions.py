"""Rounding and accent folding against Python's own."""

import unicodedata

from pyspark.sql import functions as F

from matchlens.functions import parse, text
from matchlens.functions.numbers import round_to


def test_ratios_round_half_even_on_the_binary_value(spark):
    rows = [(k, n, k / n) for n in (1, 3, 7, 8, 9, 16, 40, 200, 400, 2000) for k in range(-n, 3 * n, max(1, n // 80))]
    rows += [(0, 0, x) for x in (1.115, 0.125, 1.275, 2.675, 0.25, 0.15, 12.25, 12.35, -0.05, -1.115, 0.0, 1e9 + 0.125)]
    df = spark.createDataFrame(rows, "k long, n long, v double")
    got = df.select("v", *[round_to("v", d).alias(f"r{d}") for d in (1, 2, 3)], parse.rate_text(F.col("v")).alias("rate"), parse.hit_text(F.col("v")).alias("hit")).collect()
    for r in got:
        assert (r.r1, r.r2, r.r3) == (round(r.v, 1), round(r.v, 2), round(r.v, 3)), r.v
        assert float(r.rate) == float(f"{r.v:.1f}")
        hit = f"{abs(r.v):.3f}".lstrip("0")
        assert r.hit == ("-" + hit if r.v < 0 else hit)


def folded(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_accents_of_all_letters(spark):
    letters = "".join(chr(c) for c in [*range(0x20, 0x3000), *range(0xF900, 0xFFFD), *range(0x1D400, 0x1D7FF)] if unicodedata.category(chr(c)) not in ("Cn", "Cs"))
    names = ["Ștefan Popescu", "Nguyễn Thị Ánh", "José Núñez", "Jose\u0301 Nu\u0301n\u0303ez", "ﬁne ½ ᴸᶦᵛᵉ", "plain", "", "Łódź"]
    texts = [*names, *[letters[i : i + 97] for i in range(0, len(letters), 97)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_accents("t").alias("f"), text.plain_name("t").alias("p"))
    got = {r.t: (r.f, r.p) for r in df.collect()}
    for t in texts:
        assert got[t][0] == folded(t), t
    assert got["Ștefan Popescu"][1] == "stefan popescu" and got["Nguyễn Thị Ánh"][1] == "nguyen thi anh"
