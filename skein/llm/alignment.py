"""Alignment of two tokenizers' tokens over the same bytes.

Python only tokenises: each text comes back as two arrays of tokens, longs with the end above and the id below, and two
arrays of the byte offsets at which the tokens end. A worker tokenises parts of texts, cut where the tokens of both are
certainly those of the whole, and keeps the ids of short parts, so words that come again aren't merged again. Everything after that is Spark's higher-order functions on those arrays. ``array_intersect`` of the end arrays
gives the offsets where tokens of both end; they cut a text into groups. To write a group's ids, a tokenizer's tokens
are sorted together with a mark for each token whose end isn't common, which thus stands
right behind its token and joins it to the next one; the arrays of both sides' groups are then zipped. The tokens that
end a group are linked: their byte ranges end together.

A pair's count is how many links of the corpus hold it. Groups stay arrays in a table of one row a text; they are
exploded inside tasks and counted as texts, so what is shuffled is one row for each different group and task, and links
are read from the different texts only. To look counts up, texts that make up at least one in HOT of all groups go to
every task: there can't be more than HOT of them, whatever the corpus is. The other groups are summed by text of the
corpus and joined by shuffle; each is too rare for its key to be hot. A B id's highest count is one row for each id of
that vocabulary, which bounds it.

A is the byte-level vocabulary, given space + text; B is the piece vocabulary, which adds the space itself. Special
tokens' strings in a text are plain text. Ids of A come from tiktoken up to U+0500, where all Unicode tables agree on
what a letter is, and from the tokenizers library beyond.

Defined cases: texts that are null or empty, or whose tokens' bytes of A or B aren't space + text (a normalizer changed
them, say), have no tokens: zeros, no links, and '' for the groups' digest; repeated rows each count; rows without an id
stand for themselves; columns of the alignment's own names are replaced and others pass through ``aligned``; an empty
table stays empty.
"""

from __future__ import annotations

import functools
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.bpe import AGREED, alphabet
from skein.llm.common import free_names, read_table, ship, written

#: Texts that are Python objects at a time.
ROWS = 64
#: So many group texts at most are sent to every task.
HOT = 1 << 17
#: A worker keeps the ids of some twice so many parts of texts, of up to so many characters each.
KEPT, SHORT = 150_000, 48
#: Parts are tokenised together up to so many characters.
TOGETHER = 1 << 17
#: Stands before parts when B reads them, as it adds its space to what comes first.
LEAD = "x"
#: White space before which a text may be cut.
WHITE = " \t\n\x0b\x0c\r"
#: Masks an id, and is none itself.
MARK = 2**31 - 1
NONE = np.zeros(0, np.int32)
ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_best", "count_sum"]


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def check_ranks(path: str) -> None:
    """Whether ids may stand for ranks: every longer token is made by a merge, and ids rise with the merges."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][x] for x in made]
    if ids != sorted(ids) or {x for x in model["vocab"] if len(x) > 1} - set(made) - special:
        raise ValueError(f"{path}: its ids don't follow its merges")


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        check_ranks(byte_path)
        self.library = Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        byte_of = {c: b for b, c in enumerate(alphabet())}
        self.a_tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        for token, k in vocabulary.items():
            self.a_tokens[k] = token.encode() if token in special else bytes(map(byte_of.__getitem__, token))
        ranks = {self.a_tokens[k]: k for token, k in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_tokens = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace("▁", " ").encode() for k in range(self.pieces.get_piece_size()) for p in (self.pieces.id_to_piece(k),)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)) or [0], np.int64) for t in (self.a_tokens, self.b_tokens))
        self.cut = self._cutter(piece_path)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.before = self.known
        self.lead_size = len(self.pieces.encode(LEAD, out_type=int, num_threads=1))

    def _cutter(self, piece_path: str):
        """Cuts space + text into parts whose tokens are those of the whole: in front of white space that follows something else.

        A's pre-tokenizer always starts anew there. B's merges don't cross where no piece holds such white space behind
        something else, if its normalizer leaves texts as they are. None where that isn't so.
        """
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(Path(piece_path).read_bytes())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        if not plain or train.model_type != train.BPE or train.treat_whitespace_as_suffix or self.library.normalizer is not None:
            return None
        shown = [p.piece.replace("▁", " ") for p in model.pieces]
        held = {y for p in shown for x, y in zip(p, p[1:], strict=False) if y in WHITE and not x.isspace()}
        if " " in held:
            return None
        cut = re.escape("".join(c for c in WHITE if c not in held))
        # other white space goes with what is before it and what follows
        other = rf"[^\S{cut}]\s*"
        return re.compile(rf"\s*\S+(?:{other}\S+)*(?:{other})?|\s+").findall

    def a_ids(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) < AGREED:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if text:
            whole, b = b" " + text.encode(), self.pieces.encode(text, out_type=int, num_threads=1)
            if b"".join(map(self.b_tokens.__getitem__, b)) == whole:
                a = self.a_ids(" " + text)
                # A changes no byte, so their number tells
                if self.a_sizes[a].sum() == len(whole):
                    return a.view(np.int32), np.array(b, np.int32)
        return NONE, NONE

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts, tokenised as one text; None for those whose bytes aren't the part's."""
        whole = "".join(parts)
        b = self.pieces.encode(LEAD + whole, out_type=int, num_threads=1)[self.lead_size :]
        if b"".join(map(self.b_tokens.__getitem__, b)) == whole.encode():
            ids = self.a_ids(whole).view(np.int32), np.array(b, np.int32)
            ends = [np.cumsum(sizes[x]) for x, sizes in zip(ids, (self.a_sizes, self.b_sizes), strict=True)]
            stops = np.cumsum([len(p.encode()) for p in parts])
            last = [np.minimum(np.searchsorted(e, stops), len(e) - 1) for e in ends]
            if all((e[k] == stops).all() for e, k in zip(ends, last, strict=True)):
                (a, a_at), (b, b_at) = ((x.tobytes(), [0, *(4 * k + 4).tolist()]) for x, k in zip(ids, last, strict=True))
                for k, part in enumerate(parts):
                    self.known[part] = a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]]
                return
        if len(parts) == 1:
            self.known[parts[0]] = None
        else:
            self._learn(parts[: len(parts) // 2])
            self._learn(parts[len(parts) // 2 :])

    def _learn_all(self, parts: set[str]) -> list[str]:
        """Makes all parts known; returns those that are too long to be kept."""
        new = []
        for part in parts:
            if part not in self.known:
                if part in self.before:
                    self.known[part] = self.before[part]
                else:
                    new.append(part)
        # what ends in white space can't stand before another part, and some characters are read more slowly
        alone = [p for p in new if p[-1].isspace()]
        quick = [p for p in new if not p[-1].isspace() and (p.isascii() or max(p) < AGREED)]
        slow = [p for p in new if not (p[-1].isspace() or p.isascii() or max(p) < AGREED)]
        for part in alone:
            self._learn([part])
        for some in (quick, slow):
            start = size = 0
            for k, part in enumerate(some):
                size += len(part)
                if size >= TOGETHER or k == len(some) - 1:
                    self._learn(some[start : k + 1])
                    start, size = k + 1, 0
        return [p for p in new if len(p) > SHORT]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B for each text; none where their bytes aren't those of space + text.

        Ids of parts are kept. When there are KEPT, they go with the next lot unless they come again.
        """
        if self.cut is None:
            return list(map(self._whole, texts))
        cut = [self.cut(" " + t) if t else [] for t in texts]
        long, out = self._learn_all(set().union(*cut)), []
        for parts in cut:
            found = list(map(self.known.__getitem__, parts))
            if not found or None in found:
                out.append((NONE, NONE))
            else:
                out.append(tuple(np.frombuffer(b"".join(x), np.int32) for x in zip(*found, strict=True)))
        for part in long:
            del self.known[part]
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]


@functools.cache
def load(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _lists(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The lists of tokens as longs, a token's end above its id, and the lists of the offsets where they end."""
    counts, flat = np.array(list(map(len, ids)), np.int64), np.concatenate([NONE, *ids])
    starts = np.r_[0, np.cumsum(counts)]
    ends = np.cumsum(sizes[flat])
    before = np.r_[0, ends][starts[:-1]]
    ends = ends - np.repeat(before, counts)
    offsets = pa.array(starts, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(ends << 32 | flat)), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32)))


def tokenised(df: DataFrame, text: str = "text", byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """df with arrays a_tokens, a_ends, b_tokens and b_ends in place of its text: all that Python does."""
    ship(df.sparkSession)
    default = paths()
    where = (byte_path or default[0], piece_path or default[1])
    names = ["a_tokens", "a_ends", "b_tokens", "b_ends"]
    rest = [c for c in df.columns if c.lower() not in {*names, text.lower()}]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, T.ArrayType(T.LongType() if c.endswith("tokens") else T.IntegerType(), False), False) for c in names])

    def run(batches):
        both = load(*where)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = both.encode_all([t or "" for t in part.column(len(rest)).to_pylist()])
                new = [*_lists([a for a, _ in found], both.a_sizes), *_lists([b for _, b in found], both.b_sizes)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *new], names=[*rest, *names])

    return df.select(*[df[c] for c in rest], df[text]).mapInArrow(run, schema)


def _sorted(tokens: str, inner: str) -> Column:
    """A tokenizer's tokens by end; where one ends inside its group, a mark stands right behind it."""
    marks = F.transform(inner, lambda e: F.shiftleft(e.cast("long"), 32) + F.lit(MARK))
    return F.sort_array(F.concat(tokens, marks))


def _parts(tokens: str) -> Column:
    """The ids of each group, as text."""
    ids = F.transform(tokens, lambda x: x.bitwiseAND(F.lit(MARK))).cast("array<string>")
    return F.split(F.replace(F.array_join(ids, ";"), F.lit(f";{MARK};"), F.lit(",")), ";")


def _then(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed first: what a higher-order function takes in is compiled only where it is a column by then, so the optimizer is kept from merging the two."""
    return df.withColumns(columns).select("*", F.explode(F.array(F.lit(0))).alias("_then")).drop("_then")


def aligned(tokens: DataFrame) -> DataFrame:
    """tokens (with a_tokens, a_ends, b_tokens, b_ends) with n_a, n_b and ``groups`` instead: each group's ids of A, '|', its ids of B."""
    own = ["a_tokens", "a_ends", "b_tokens", "b_ends"]
    rest = [c for c in tokens.columns if c.lower() not in {*own, *ADDED}]
    held = tokens.select(F.struct(*[tokens[c] for c in rest], F.lit(0).alias("_")).alias("row"), *own)
    # columns of their own: inside a higher-order function's argument they would be interpreted, with boxed integers
    step = _then(held, common=F.array_intersect("a_ends", "b_ends"), a_inner=F.array_except("a_ends", "b_ends"), b_inner=F.array_except("b_ends", "a_ends"))
    sizes = [F.size(c).cast("long").alias(n) for n, c in (("n_a", "a_tokens"), ("n_b", "b_tokens"), ("n_groups", "common"))]
    step = _then(step, a=_sorted("a_tokens", "a_inner"), b=_sorted("b_tokens", "b_inner")).select("row", *sizes, "a", "b")
    step = _then(step, a_parts=_parts("a"), b_parts=_parts("b"))
    groups = F.zip_with("a_parts", "b_parts", lambda a, b: F.concat(a, F.lit("|"), b))
    done = step.withColumn("groups", F.when(F.col("n_groups") > 0, groups).otherwise(F.array().cast("array<string>")))
    return done.select(*[F.col("row")[c].alias(c) for c in rest], "n_a", "n_b", "n_groups", "groups")


def linked(group: str) -> list[Column]:
    """Columns a and b: the tokens that end a group, from its text."""
    last = lambda ids: F.substring_index(ids, ",", -1).cast("int")
    return [last(F.substring_index(group, "|", 1)).alias("a"), last(F.substring_index(group, "|", -1)).alias("b")]


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, count, best) from group texts and how often they come: how many links hold the pair, and whether none of its b has more."""
    counts = written(texts.groupBy(*linked("group")).agg(F.sum("times").alias("count")), "pair_counts")
    # one row for each id of B's vocabulary at most
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(groups: DataFrame, row: str, hot: int = HOT) -> DataFrame:
    """(row, n_best, count_sum) for each value of the column ``row`` that has groups."""
    each = groups.select(row, F.explode("groups").alias("group"))
    texts = written(each.groupBy("group").agg(F.count("*").alias("times")), "texts")
    total = texts.agg(F.sum("times")).first()[0] or 0
    known = written(texts.select("group", "times", *linked("group")).join(pair_counts(texts), ["a", "b"]).select("group", "times", "count", "best"), "known")
    # at most ``hot`` texts can make up one in ``hot`` of all groups each
    often = F.col("times") * F.lit(hot) >= F.lit(total)
    looked_up = each.join(F.broadcast(known.filter(often).select("group", "count", "best")), "group", "left")
    # one row a text and task for all its hot groups, and one for each different rare group
    part = looked_up.groupBy(row, F.when(F.col("count").isNull(), F.col("group")).alias("rare"))
    part = written(part.agg(F.count("*").alias("own"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum")), "looked_up")
    late = part.filter("rare IS NOT NULL").select(row, F.col("rare").alias("group"), "own").join(known.filter(~often), "group")
    late = late.select(row, F.when(F.col("best"), F.col("own")).otherwise(0).alias("n_best"), (F.col("count") * F.col("own")).alias("count_sum"))
    both = part.filter("rare IS NULL").select(row, "n_best", "count_sum").union(late)
    return both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _aligned_rows(df: DataFrame, row: str, text: str, byte_path: str | None, piece_path: str | None) -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, groups and their digest, as a table: from here on ``row`` names a row."""
    rest = [c for c in df.columns if c.lower() not in {*ADDED, text.lower()}]
    tokens = tokenised(df.select(*rest, text).withColumn(row, F.monotonically_increasing_id()), text, byte_path, piece_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("")
    return written(aligned(tokens).withColumn("groups_sha256", digest), "groups")


def _with_sums(groups: DataFrame, row: str, hot: int, *columns: str) -> DataFrame:
    """columns of the groups' table with the counts of its links; only these columns move."""
    sums = written(scored(groups, row, hot), "sums")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = groups.select(row, *columns).join(sums, row, "left")
    return joined.select(*columns, F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"))


def align(df: DataFrame, text: str = "text", byte_path: str | None = None, piece_path: str | None = None, hot: int = HOT) -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, groups, groups_sha256, n_links, n_best and count_sum."""
    (row,) = free_names(df, "text_row")
    groups = _aligned_rows(df, row, text, byte_path, piece_path)
    return _with_sums(groups, row, hot, *[c for c in groups.columns if c != row])


def op12_cross_tokenizer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = _aligned_rows(docs, "text_row", "text", None, None)
    return _with_sums(groups, "text_row", HOT, "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")


QUERIES = {"op12_cross_tokenizer_links": op12_cross_tokenizer_links}
#: SQL has no tokenizers; the tests hold it against dictionaries.
ORACLES: dict[str, str] = {}
