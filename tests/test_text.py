import random

import pytest
from pyspark.sql import functions as F

from tests import brute
from verbamatch import MatchConfig, StageConfigError, StageProcessingError
from verbamatch.functions import text
from verbamatch.operators import pipeline


def apply(spark, rows, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", build(F.col("t"))).collect())]


def test_clean_examples(spark):
    got = apply(spark, ["Custa <money:30.5> na feira!", "Ele não gostou do João, que pagou R$ 50,00 na loja.", "a\\r\\nb\\tc\r\nd", "", None, "do do x", "nums numas"], text.clean)
    assert got[0] == "custa <money:30.5> em a feira"
    assert got[1] == "ele nao gostou de o joao que pagou r$ 5000 em a loja."
    assert got[2:] == ["a b c d", "", None, "de o do x", "em uns em umas"]


def test_clean_flags(spark):
    assert apply(spark, ["É do Zé!"], lambda c: text.clean(c, accents=False)) == ["de o z"]
    assert apply(spark, ["É do Zé!"], lambda c: text.clean(c, contracted=False)) == ["e do ze"]
    assert apply(spark, ["É do Zé!"], lambda c: text.clean(c, punctuation=False)) == ["e de o ze!"]


def test_folds_of_one_character_to_many(spark):
    assert apply(spark, ["½ ﬁm ™ ß œ", "ﷺ"], text.strip_accents) == ["12 fim TM  ", brute.unicodedata.normalize("NFKD", "ﷺ").encode("ascii", "ignore").decode()]


def test_tokens_and_stopwords(spark):
    line = "custa <money:30.5> em a feira s22-ultra"
    assert apply(spark, [line], text.tokenize) == [["custa", "<money:30.5>", "em", "a", "feira", "s22-ultra"]]
    kept = apply(spark, ["ele nao gostou de o joao <money:10>"], lambda c: text.drop_stopwords(text.blank_tokens(c)))
    assert kept == [["gostou", "joao", "<money:10>"]]
    own = apply(spark, ["ele x y"], lambda c: text.drop_stopwords(text.blank_tokens(c), False, ["x"]))
    assert own == [["ele", "y"]]


LETTERS = "abcdeçãé R$<>:.-\t\n,!5ª½ do na\\r"


def test_prepare_against_plain_python(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows += [" ".join(rng.choice(["do", "na", "à", "às", "pelo", "o", "não", "Ção", "x-1", "<a:b c>"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    assert apply(spark, rows, text.clean) == [brute.clean(t) for t in rows]
    assert apply(spark, rows, text.prepare) == [brute.prepare(t) for t in rows]
    assert apply(spark, rows, text.terms) == [brute.terms(t) for t in rows]


def test_phonetic_forms(spark):
    assert apply(spark, ["chuva quente", "homem", "carro  ninho", ""], text.phonetic) == ["xuva kente", "omen", "karo nino", ""]
    pairs = [("casa", "kasa"), ("passo", "paso"), ("gente", "jente"), ("cinema", "sinema"), ("homem", "omen")]
    for a, b in pairs:
        x, y = apply(spark, [a, b], text.phonetic)
        assert x == y, (a, b, x, y)


def single_pass(word: str) -> str:
    out, i, pairs = "", 0, dict(text._SOUNDS)
    while i < len(word):
        if word[i : i + 2] in pairs:
            out += pairs[word[i : i + 2]]
            i += 2
        else:
            out += {"c": "k", "h": ""}.get(word[i], word[i])
            i += 1
    out = out.replace("c", "k").replace("h", "")
    return out[:-1] + "n" if out.endswith("m") else out


def test_phonetic_against_a_single_pass(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice("scqurelhingm") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    got = apply(spark, rows, text.phonetic)
    # Overlapping digraphs (sss, lll) leave room for the order of replacement; all others agree.
    same = [g == single_pass(t) for g, t in zip(got, rows)]
    assert sum(same) >= 0.9 * len(same)


def test_pipeline_stages(spark):
    df = spark.createDataFrame([("Ele NÃO gostou",), (None,)], "t string")
    run = pipeline.Pipeline([pipeline.clean_stage(), pipeline.tokenize_stage()]).add_stage(pipeline.stopword_stage())
    assert [r.t for r in run.process(df, "t").collect()] == ["gostou", None]
    with pytest.raises(StageConfigError):
        run.add_stage("no stage")

    def broken(now, column):
        raise ValueError("broken on purpose")

    with pytest.raises(StageProcessingError) as e:
        pipeline.Pipeline([broken]).process(df, "t")
    assert isinstance(e.value.original_error, ValueError)


def test_lemmas_leave_tags(spark):
    config = MatchConfig(lemmatizer=lambda ws: [w.rstrip("s") for w in ws])
    df = spark.createDataFrame([("gatos <x:as> pretos",), ("",), (None,)], "t string")
    got = [r.p for r in pipeline.prepared(df, "t", "p", config).collect()]
    assert set(got) == {"", None, "gato <x:as> preto"}


def test_preparation_once_per_distinct_text_keeps_rows(spark):
    df = spark.createDataFrame([("GN 500",), ("GN 500",), (None,), ("",)], "t string")
    got = [r.p for r in pipeline.prepared(df, "t", "p", MatchConfig.smart()).collect()]
    assert sorted(map(str, got)) == sorted(["<productmodel:gn500>"] * 2 + ["None", ""])
