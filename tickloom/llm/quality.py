"""A quality classifier by attention over passages.

Every text is a bag of passages of 64 words. A passage is encoded from its letters, marks and repeats; gated attention
weighs a text's passages, and the weighted sum of their codes is scored. Only texts have labels: which passages matter is
learned from them. All layers are fitted together on a bounded sample of labelled texts, at most SAMPLE_TEXTS of each
label, whose weights restore the labels' true shares; Spark encodes and scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.anchors import Block, mixed
from tickloom.llm.common import anonymous, identified, remainder, staged, text_bytes

PASSAGE_WORDS = 64
SAMPLE_TEXTS = 3000  # of each label
SAMPLE_PASSAGES = 150_000  # of each label: texts are sampled, whole, as long as their passages come to no more
GRAMS = 48
CODE, GATE = 24, 12
EPOCHS, BATCH, RATE = 40, 128, 0.01
PENALTY = 1e-3
REPEATED_WORDS = 6

# Kinds of bytes that are counted apart; others are one kind.
KINDS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".", b",", b"!?", b"|",
    b"#$%&*+=<>@^~_/\\{}[]", b"'\"-:;()", bytes(range(128, 256)),
)
KIND = np.full(256, len(KINDS), dtype=np.int64)
for _place, _bytes in enumerate(KINDS):
    KIND[list(_bytes)] = _place
NUMBERS = len(KINDS) + 1 + GRAMS + 7


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of each passage, how many passages each text has); an empty text is one empty passage."""
    block = Block(texts, words=True)
    each = np.maximum(1, -(-block.counts // PASSAGE_WORDS))
    passages = int(each.sum())
    first = np.repeat(block.first, each) + PASSAGE_WORDS * (np.arange(passages) - np.repeat(np.cumsum(each) - each, each))
    last = np.minimum(first + PASSAGE_WORDS, np.repeat(block.first + block.counts, each))
    size = last - first
    filled = np.flatnonzero(size)
    found = np.zeros((passages, NUMBERS), dtype=np.float32)
    if not len(filled):
        return found, each
    word_of = np.repeat(np.arange(passages), size)  # passage of each word
    lengths = block.ends - block.starts + 1
    byte_of = np.repeat(word_of, lengths)[: len(block.data)]
    kinds = np.bincount(byte_of * (len(KINDS) + 1) + KIND[block.data], minlength=passages * (len(KINDS) + 1))
    bytes_of = np.maximum(1, np.bincount(byte_of, minlength=passages))[:, None]
    found[:, : len(KINDS) + 1] = kinds.reshape(passages, -1) / bytes_of
    pairs = (block.data[:-1].astype(np.int64) * 31 + block.data[1:].astype(np.int64) * 17) % 1009 % GRAMS
    grams = np.bincount(byte_of[:-1] * GRAMS + pairs, minlength=passages * GRAMS)
    found[:, len(KINDS) + 1 : len(KINDS) + 1 + GRAMS] = grams.reshape(passages, -1) / bytes_of
    words = block.hashes(1)
    inside = np.maximum(1, size)
    keys, counts = np.unique(mixed(words) ^ mixed(word_of.astype(np.uint64)), return_inverse=True, return_counts=True)[1:]
    own = counts[keys]  # how often the passage has this word
    rest = found[:, len(KINDS) + 1 + GRAMS :]
    rest[:, 0] = np.bincount(word_of, weights=1 / own, minlength=passages) / inside
    rest[filled, 1] = np.maximum.reduceat(own, first[filled]) / inside[filled]
    same = np.flatnonzero((words[1:] == words[:-1]) & (word_of[1:] == word_of[:-1])) + 1
    rest[:, 2] = np.bincount(word_of[same], minlength=passages) / inside
    rest[:, 3] = np.bincount(word_of, weights=lengths - 1, minlength=passages) / inside / 10
    rest[:, 4] = np.log1p(size) / 5
    rest[:, 5] = np.bincount(word_of[lengths <= 2], minlength=passages) / inside
    runs = block.hashes(REPEATED_WORDS)
    if len(runs):
        text_of = block.text_of(np.arange(len(runs))).astype(np.uint64)
        back, counts = np.unique(mixed(runs) ^ mixed(text_of), return_inverse=True, return_counts=True)[1:]
        again = np.flatnonzero(counts[back] > 1)
        rest[:, 6] = np.bincount(word_of[again], minlength=passages) / inside
    return found, each


class Attention:
    """Encoder, gated attention and output, and the scale of the numbers they read."""

    def __init__(self, numbers: int, seed: int = 4) -> None:
        random = np.random.default_rng(seed)
        scaled = lambda a, b: random.normal(0, a**-0.5, (a, b))
        self.mean, self.deviation, self.shift = np.zeros(numbers), np.ones(numbers), 0.0
        self.layers = {
            "code": scaled(numbers, CODE), "code_bias": np.zeros(CODE), "value": scaled(CODE, GATE), "gate": scaled(CODE, GATE),
            "gate_bias": np.zeros(GATE), "weight": scaled(GATE, 1)[:, 0], "out": scaled(CODE, 1)[:, 0], "bias": np.zeros(1),
        }

    def forward(self, numbers: np.ndarray, each: np.ndarray) -> tuple:
        w, starts = self.layers, np.cumsum(each) - each
        x = np.clip((numbers - self.mean) / self.deviation, -8, 8)
        code = np.tanh(x @ w["code"] + w["code_bias"])
        value, gate = np.tanh(code @ w["value"]), 1 / (1 + np.exp(-(code @ w["gate"] + w["gate_bias"])))
        raw = (value * gate) @ w["weight"]
        powers = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), each))
        share = powers / np.repeat(np.add.reduceat(powers, starts), each)
        whole = np.add.reduceat(share[:, None] * code, starts, axis=0)
        return x, code, value, gate, share, whole, whole @ w["out"] + w["bias"][0]

    def gradients(self, numbers: np.ndarray, each: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        w, starts = self.layers, np.cumsum(each) - each
        x, code, value, gate, share, whole, logit = self.forward(numbers, each)
        error = (1 / (1 + np.exp(-logit)) - label) * weight / weight.sum()
        to_whole = np.repeat(error[:, None] * w["out"], each, axis=0)
        to_share = (to_whole * code).sum(axis=1)
        to_raw = share * (to_share - np.repeat(np.add.reduceat(share * to_share, starts), each))
        to_value = to_raw[:, None] * w["weight"] * gate * (1 - value * value)
        to_gate = to_raw[:, None] * w["weight"] * value * gate * (1 - gate)
        to_code = share[:, None] * to_whole + to_value @ w["value"].T + to_gate @ w["gate"].T
        to_code = to_code * (1 - code * code)
        found = {
            "code": x.T @ to_code, "code_bias": to_code.sum(axis=0), "value": code.T @ to_value, "gate": code.T @ to_gate,
            "gate_bias": to_gate.sum(axis=0), "weight": (value * gate).T @ to_raw, "out": whole.T @ error, "bias": error.sum(keepdims=True),
        }
        return {name: found[name] + PENALTY * w[name] * ("bias" not in name) for name in found}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 4) -> Attention:
        """Adam over all layers; the order of the bags must not depend on the run."""
        together = np.concatenate(bags)
        self.mean, self.deviation = together.mean(axis=0), together.std(axis=0) + 1e-6
        random, step = np.random.default_rng(seed), 0
        first = {name: np.zeros_like(value) for name, value in self.layers.items()}
        second = {name: np.zeros_like(value) for name, value in self.layers.items()}
        for epoch in range(EPOCHS):
            order = random.permutation(len(bags))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for at in range(0, len(order), BATCH):
                lot = order[at : at + BATCH]
                each = np.array([len(bags[i]) for i in lot])
                slopes = self.gradients(np.concatenate([bags[i] for i in lot]), each, labels[lot], weights[lot])
                step += 1
                for name, slope in slopes.items():
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.999 * second[name] + 0.001 * slope * slope
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.layers[name] = self.layers[name] - rate * change
        return self

    def scores(self, numbers: np.ndarray, each: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(numbers, each)[-1], -35, 35)))


def train(docs: DataFrame, labels: DataFrame) -> Attention | float:
    """Fitted on rows of ``docs`` with a label (doc_id, quality 0 or 1); the share of ones where only one kind is there.

    Without any label that share is taken as a half. Null labels and ids are none; of several labels of an id the
    smallest counts. The sample is the first SAMPLE_TEXTS of each label by hash of the id, as far as their passages come
    to SAMPLE_PASSAGES; a text of the sample is taken whole. A longer text than that is not sampled, and if a label has
    only such texts nothing is fitted: the score is the share of ones.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = staged(docs.select("doc_id").join(known, "doc_id"), "quality-labels")
    sizes = {row["quality"]: row["n"] for row in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    by_hash = F.xxhash64("doc_id", F.lit(4))

    def first(rows: DataFrame, *ties: str) -> DataFrame:
        return rows.where("quality = 0").orderBy(by_hash, "doc_id", *ties).limit(SAMPLE_TEXTS).union(
            rows.where("quality = 1").orderBy(by_hash, "doc_id", *ties).limit(SAMPLE_TEXTS)
        )

    # At most 2 * SAMPLE_TEXTS ids, so they may be sent to every task; the texts stay where they are.
    chosen = staged(first(known.distinct()).select("doc_id", F.col("quality").cast("int").alias("quality")), "quality-ids")

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, each = encode([text_bytes(text) for text in batch["text"]])
            bags = np.split(found, np.cumsum(each)[:-1])
            packed = [bag.astype("<f4").tobytes() for bag in bags]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bag": packed})

    schema = "doc_id long, quality int, bag binary"
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(numbers, schema)
    sample = staged(sample, "quality-sample").withColumn("passages", F.octet_length("bag") / F.lit(4 * NUMBERS))
    sofar = Window.partitionBy("quality").orderBy(by_hash, "doc_id", "bag").rowsBetween(Window.unboundedPreceding, 0)
    fitting = sample.where(F.col("passages") <= SAMPLE_PASSAGES).withColumn("sofar", F.sum("passages").over(sofar))
    sample = first(fitting.where(F.col("sofar") <= SAMPLE_PASSAGES).drop("passages", "sofar"), "bag").toPandas()
    if sample["quality"].nunique() < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    sample = sample.sort_values(["quality", "doc_id", "bag"], kind="stable")
    bags = [np.frombuffer(bag, dtype="<f4").reshape(-1, NUMBERS).astype(np.float64) for bag in sample["bag"]]
    label = sample["quality"].to_numpy(np.float64)
    taken = sample["quality"].value_counts()
    weights = sample["quality"].map(lambda kind: sizes[kind] / taken[kind]).to_numpy(np.float64)
    return Attention(NUMBERS).fit(bags, label, weights)


def score(docs: DataFrame, model: Attention | float) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text): 0 to 1, higher for better. Null texts are empty."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found, each = encode([text_bytes(text) for text in batch["text"]])
            scores = np.full(len(batch), model) if isinstance(model, float) else model.scores(found, each)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores})

    return anonymous(identified(docs).mapInPandas(of, "doc_id long, score double"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    model = train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    scored = staged(score(docs, model), "quality-scores")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
