import base64
import importlib.util
from pathlib import Path

import pytest
import tiktoken
from test_bpe import row
from test_decontaminate import brute as leaks
from test_line_dedup import brute as cut_lines
from test_simhash import classes, print_of

import corpus_pipeline as P
from dwellspark.llm import quality as Q
from dwellspark.llm.queries import PATTERN, RANKS


def test_pipeline_equals_brute_force(spark, folder, documents):
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    model = Q.train(documents, labels)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    docs = [(i, t) for i, t in docs if Q.judge(t or "", model)[-1]]
    docs = [(i, t) for i, t, _, _ in cut_lines(docs)]
    own = {(i, c) for i, _, c in classes([(i, print_of(t)) for i, t in docs])}
    docs = [(i, t) for i, t in docs if (i, i) in own]
    bad = {r[0] for r in leaks(docs, [(r.item_id, r.text) for r in items.collect()])}
    docs = [(i, t) for i, t in docs if i not in bad]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = P.run(spark, folder)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect())
    assert got == sorted(row(coder, i, t) for i, t in docs) and 0 < len(got) < documents.count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, folder, documents, odd):
    rows = [(i, t, None, None, None) for i, t in odd]
    docs = documents.limit(0).unionByName(spark.createDataFrame(rows, documents.schema)).withColumn("extra", P.F.lit(1))
    for (name, stage), last in zip(P.STAGES, [False] * 4 + [True]):
        out = stage(spark, docs, folder)
        assert last or out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0
        out.collect()
    cut = {(r.doc_id, r.text, r.n_chars) for r in P.drop_lines(spark, docs, folder).collect()}
    assert all(n == len(t) for _, t, n in cut)
    assert [name for name, _ in P.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "byte-level bpe"]


def test_entry_works_without_the_operators(monkeypatch):
    """As if the folders were taken away."""
    import sys

    path = Path(__file__).parents[2] / "__spark_entry__.py"

    def load():
        spec = importlib.util.spec_from_file_location("entry_again", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module

    assert "pipeline" in load().queries() and "op1_line_dedup" in load().oracle_sql()

    class Gone:
        def find_spec(self, name, *rest):
            if name.startswith("dwellspark.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=".".join(name.split(".")[:2]))

    for name in [m for m in sys.modules if m.startswith("dwellspark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    alone = load()
    assert "pipeline" not in alone.queries() and not any(n.startswith("op1_") for n in alone.queries()) and "knn_top10" in alone.queries()
