"""Sizes of texts in tokens of public tokenizers."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sixline.llm import bpe
from sixline.llm.spread import spread

FOLDER = "/opt/tokenizers"
#: Words whose sizes a worker keeps; beyond it, it starts anew.
KEPT = 400_000


def _remembered(split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """Counts texts by their parts, each distinct part once per worker."""
    known: dict[str, int] = {}

    def sizes_of(texts: list[str]) -> list[int]:
        parts = [split(t) for t in texts]
        new = list({p for ps in parts for p in ps if p not in known})
        if len(known) > KEPT:
            known.clear()
            new = list({p for ps in parts for p in ps})
        for i in range(0, len(new), 1024):
            known.update(zip(new[i : i + 1024], count(new[i : i + 1024])))
        return [sum(map(known.__getitem__, ps)) for ps in parts]

    return sizes_of


def _apart(tokenizer) -> bool:
    """Whether a tokenizers vocabulary drops white space before anything else, so that words don't touch each other."""
    before = tokenizer.pre_tokenizer
    if before is None:
        return False
    parts = lambda t: [p for p, _ in before.pre_tokenize_str(t)]
    return all(parts(f"a{gap}b") == ["a", "b"] for gap in (" ", "  ", "\n", "\t"))


def _prefixed(model) -> bool:
    """Whether a sentencepiece vocabulary has white space only at the begin of pieces, and takes texts as they are but for one space before them."""
    from sentencepiece import sentencepiece_model_pb2

    made = sentencepiece_model_pb2.ModelProto()
    made.ParseFromString(model.serialized_model_proto())
    n = made.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    return plain and made.trainer_spec.model_type == 2 and not any("▁" in p.piece.lstrip("▁") for p in made.pieces)


def counter(name: str, folder: str = FOLDER) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, without special tokens, by the vocabulary file ``name`` has in ``folder``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = next((p for p in (f"{folder}/{name}.tiktoken", f"{folder}/{name}.model", f"{folder}/{name}.json") if os.path.exists(p)), None)
    if path is None:
        raise ValueError(f"no vocabulary {name!r} in {folder}")
    if path.endswith(".tiktoken"):
        import tiktoken

        made = tiktoken.Encoding(name, pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
        return lambda texts: [len(made.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)] if texts else []
        if not _prefixed(model):
            return count
        # No merge goes from a letter to the white space after it: a word with the space before it stands for itself.
        # The model puts a space before each text, so a part is given without its first one.
        find = re.compile(" *[^ ]+| +").findall
        return _remembered(lambda t: find(" " + t.replace("▁", " ")) if t else [], lambda parts: [n or 1 for n in count([p[1:] for p in parts])])
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    whole = lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    if not _apart(own):
        return whole
    find = re.compile(r"(?:\S|[\x1c-\x1f])+").findall  # the four separators are no white space to the vocabularies
    return _remembered(find, whole)


def sizes(df: DataFrame, keep: Sequence[str], text: str, names: Sequence[str], folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and one bigint column per tokenizer, ``n_0``, ``n_1`` ... in the order of ``names``; null texts have 0 tokens."""
    source = spread(df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    kinds = ", ".join([f"_k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"n_{i} bigint" for i in range(len(names))])
    out_names = [f"_k{i}" for i in range(len(keep))] + [f"n_{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [counter(n, folder) for n in names]
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            counts = [pa.array([n for i in range(0, len(texts), 256) for n in c(texts[i : i + 256])], pa.int64()) for c in counters]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + counts, out_names)

    found = source.mapInArrow(run, kinds)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[f"n_{i}" for i in range(len(names))])
