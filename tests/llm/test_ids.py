"""Ids beyond 2**53 beside null ids, in every Python stage; repeated and null ids of vectors."""

import math

import numpy as np
import public_tokenizers as P
import pytest

BIG = [2**60 + 1, 2**60 + 3, None, -(2**60) - 1, 7]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    from fieldmark.functions.ship import ship

    ship(spark)
    near = " ".join(WORDS * 3)
    texts = [near, near + " end", "gnu general public license", None, "SPDX-License-Identifier: MIT"]
    path = str(tmp_path_factory.mktemp("ids") / "documents.parquet")
    spark.createDataFrame(list(zip(BIG, texts, strict=True)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def ids(df, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in df.select(name).collect())


WANT = sorted((i is None, i or 0) for i in BIG)


@pytest.mark.parametrize("op", ["op2", "op4", "op5", "op7", "op9", "op10", "op13"])
def test_ids_are_exact(docs, op):
    from fieldmark.llm import huffman_files, katz_lm, license_scan, minhash_dedup, packing, pii, piece_codec

    got = {
        "op2": lambda: license_scan.license_digest(license_scan.license_scan(docs)),
        "op4": lambda: piece_codec.piece_digest(docs, P.path("piece_bpe_32k.model")),
        "op5": lambda: katz_lm.katz_scores(docs),
        "op7": lambda: minhash_dedup.near_duplicates(docs, shingle=4, percent=80),
        "op9": lambda: packing.pack_documents(docs, P.path("byte_bpe_50k.json")),
        "op10": lambda: huffman_files.huffman_round_trip(docs, P.path("word_bpe_49k.json")),
        "op13": lambda: pii.pii_digest(pii.identifiers(docs)),
    }[op]()
    assert ids(got) == WANT


def test_codec_keeps_ids(docs):
    from fieldmark.llm.piece_codec import decode_pieces, encode_pieces

    model = P.path("piece_bpe_32k.model")
    assert ids(decode_pieces(encode_pieces(docs, model), model)) == WANT


def test_near_duplicates_of_large_ids(docs):
    from fieldmark.llm.minhash_dedup import drop_near_duplicates, near_duplicates

    got = {r.doc_id: r for r in near_duplicates(docs, shingle=4, percent=80).collect()}
    assert got[2**60 + 3].component_id == 2**60 + 1 and not got[2**60 + 3].kept
    assert sorted(i for _, i in ids(drop_near_duplicates(docs))) == sorted(i or 0 for i in BIG if i != 2**60 + 3)


def test_vector_ids_against_all_pairs(spark, tmp_path):
    from fieldmark.functions.ship import ship
    from fieldmark.llm.embedding_dedup import similar_vectors

    ship(spark)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 12))
    rows = [(k, (base[k % 6] + rng.standard_normal(12) * 0.1).tolist()) for k in range(24)]
    other = rng.standard_normal(12).tolist()
    rows += [(5, other), (5, base[5].tolist()), (5, base[5].tolist()), (None, base[0].tolist()), (None, rng.standard_normal(12).tolist())]
    rows += [(2**60 + 1, base[1].tolist()), (2**60 + 3, (base[1] + 1e-3).tolist()), (None, None), (9, [0.0] * 12), (9, None), (None, other)]
    alone = rng.standard_normal(12)
    rows += [(None, alone.tolist()), (None, (alone * 2).tolist())]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, weight int, least string").coalesce(1).write.parquet(str(tmp_path / "v"))
    got = similar_vectors(spark.read.parquet(str(tmp_path / "v"))).collect()

    def linked(a, b):
        if a is None or b is None or not any(a) or not any(b):
            return False
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) >= 0.9

    n = len(rows)
    links = [[j for j in range(n) if j != i and linked(rows[i][1], rows[j][1])] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(named) if named else None
        want.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
