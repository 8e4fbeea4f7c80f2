"""Pipeline stages on a small corpus: planted cases go, clean documents stay."""

import random

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries


def test_registered():
    names = queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert set(oracle_sql()) <= set(names)


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(9)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))

    def prose(k):
        return " ".join(text(12) + "." for _ in range(k))

    clean = [(i, prose(8)) for i in range(120)]
    bench = [(i, text(30)) for i in range(4)]
    passage = prose(6)
    planted = [(500, clean[3][1]), (501, clean[4][1].replace(clean[4][1].split(" ")[5], "edit")), (502, text(20) + " " + bench[1][1] + " " + text(20)),
               (503, prose(4) + "\n" + passage + "\n" + prose(4)), (504, prose(4) + "\n" + passage + "\n" + prose(4)), (505, None), (506, "")]
    toxic = [(600 + i, " ".join(f"{text(3)} {rng.choice(['grumblet', 'snorkwit'])}" for _ in range(12))) for i in range(60)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in clean + planted + toxic]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 600)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    state, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        path = str(tmp_path / name)
        state.write.parquet(path)
        state = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in state.collect()}
        if name != "mixing":
            assert state.columns == docs.columns
    assert not any(i >= 600 for i in seen["toxicity"])
    assert {i for i, *_ in clean + planted} == set(seen["toxicity"])
    kept = seen["line_dedup"]
    assert passage.split(" ")[10] in kept[503].text and passage.split(" ")[10] not in kept[504].text
    assert kept[504].n_chars == len(kept[504].text)
    assert 500 not in kept  # every line was a repeat
    assert 502 in seen["near_dedup"] and 502 not in seen["decontamination"]
    assert {i for i, _ in clean} | {503, 504, 505, 506} <= set(seen["mixing"])
