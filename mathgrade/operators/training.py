"""Training-data preparation (D1-D7): chat messages, ChatML text,
tokenisation with truncation/padding, label masks and train/validation split.

The default tokenizer is native (whitespace pieces, ids by a stable hash) so
the whole job stays in the JVM; a caller's subword tokenizer plugs in as an
Arrow-batched pandas UDF (``pandas_tokenizer``), created once per batch
iterator rather than per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.answers import last_line_number, once
from ..functions.text import messages, strip

MASK = -100
PAD_ID = 0
#: Tokens of a training example; longer ones are truncated, as the trainer's input has a fixed width.
MAX_LENGTH = 1024


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chat_example(task, solution, system_prompt: str) -> Column:
    """System / user = task / assistant = solution + final-answer line."""
    final = last_line_number(solution)
    assistant = F.concat(strip(solution), F.lit(P.FINAL_SENTENCE), final, F.lit(P.FINAL_SENTENCE_END))
    return messages(system_prompt, task, assistant)


def chatml(msgs, add_generation_prompt: bool = True) -> Column:
    """D2: '<|im_start|>role\\ncontent<|im_end|>\\n' per message, plus the
    assistant generation prompt."""
    body = F.array_join(F.transform(_col(msgs), lambda m: F.concat(
        F.lit(P.IM_START), m["role"], F.lit("\n"), m["content"], F.lit(P.IM_END + "\n"))), "")
    if add_generation_prompt:
        body = F.concat(body, F.lit(P.ASSISTANT_TAG + "\n"))
    return body


def conversation_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                          role: str = "role", content: str = "text") -> DataFrame:
    """Collect ordered turns into a messages array per conversation (one
    hash aggregate; ``array_sort`` on (turn, ...) restores order)."""
    agg = turns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"),
                                             F.col(content).alias("content")))).alias("_m"))
    return agg.select(key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                m["content"].alias("content"))).alias("messages"))


# --------------------------------------------------------------------------
# D3 tokenisation
# --------------------------------------------------------------------------

def whitespace_pieces(text) -> Column:
    """Native tokenizer: special markers and non-blank runs become pieces."""
    return F.regexp_extract_all(_col(text), F.lit(r"<\|im_start\|>|<\|im_end\|>|[^\s<]+|<"), F.lit(0))


def piece_ids(pieces, vocab_size: int = 50000) -> Column:
    """Stable ids for pieces: 1 and 2 for the ChatML markers, hash otherwise."""
    return F.transform(_col(pieces), lambda p: F.when(p == P.IM_START, F.lit(1))
                       .when(p == P.IM_END, F.lit(2))
                       .otherwise((F.pmod(hash32(p), F.lit(vocab_size - 3)) + 3).cast("int")))


def hash32(c) -> Column:
    """First 32 bits of md5 as a non-negative integer: stable across engines."""
    return F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def pad_truncate(ids, max_length: int | None = MAX_LENGTH, pad_id: int = PAD_ID) -> Column:
    """D3: truncate to max_length and right-pad; returns struct(input_ids,
    attention_mask). Without a length nothing is cut or padded."""
    if max_length is None:
        return F.struct(_col(ids).alias("input_ids"), F.transform(_col(ids), lambda _: F.lit(1)).alias("attention_mask"))
    a = F.slice(_col(ids), 1, max_length)
    n = F.size(a)
    pad = F.array_repeat(F.lit(pad_id), F.lit(max_length) - n)
    return F.struct(F.concat(a, pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
                    .alias("attention_mask"))


def pandas_tokenizer(make_tokenizer: Callable[[], Callable[[str], list[int]]]):
    """Wrap a caller's tokenizer factory as an Arrow-batched UDF returning
    array<int>; the tokenizer is built once per batch iterator."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tok(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_tokenizer()
        for s in it:
            yield s.map(lambda x: None if x is None else list(fn(x)))

    return tok


# --------------------------------------------------------------------------
# D4-D6 label masks (padding masked as well unless compat=True, quirk Q15)
# --------------------------------------------------------------------------

def _mask_before(ids: Column, attention: Column | None, cut: Column, compat: bool) -> Column:
    """The cut is evaluated once per row, not per position."""
    def labels(limit):
        def lab(x, i):
            masked = i < limit
            if attention is not None and not compat:
                masked = masked | (F.element_at(attention, i + 1) == 0)
            return F.when(masked, F.lit(MASK)).otherwise(x)
        return F.transform(ids, lab)
    return once(cut, labels)


def mask_third_marker(ids, attention=None, marker_id: int = 1, compat: bool = False) -> Column:
    """Mask through the third occurrence of the turn marker; if there are
    fewer than three, mask position 0 only."""
    a = _col(ids)
    pos = F.filter(F.transform(a, lambda x, i: F.when(x == marker_id, i)), lambda v: v.isNotNull())
    third = F.try_element_at(pos, F.lit(3))
    cut = F.coalesce(third, F.lit(0)) + 1
    return _mask_before(a, _col(attention) if attention is not None else None, cut, compat)


def mask_prefix_count(ids, n_prefix_tokens, attention=None, compat: bool = False) -> Column:
    """Mask the first (tokens before the assistant marker) + 1 positions."""
    return _mask_before(_col(ids), _col(attention) if attention is not None else None,
                        _col(n_prefix_tokens) + 1, compat)


def mask_before_marker(ids, marker_id, attention=None, compat: bool = False) -> Column:
    """Mask positions before the answer marker's first token (+1); not
    found -> no mask."""
    a = _col(ids)
    p = F.array_position(a, marker_id if isinstance(marker_id, Column) else F.lit(marker_id))
    cut = F.when(p > 0, p).otherwise(F.lit(0))
    return _mask_before(a, _col(attention) if attention is not None else None, cut, compat)


def prefix_token_count(text, tag: str = P.ASSISTANT_TAG) -> Column:
    """Number of native tokens before the first assistant marker (for D5)."""
    before = F.substring_index(_col(text), tag, 1)
    return F.size(whitespace_pieces(before))


def split_label(key, frac: float = 0.05, seed: int = 42, buckets: int = 10000) -> Column:
    """D7 / P15: 'validation' for a stable hash share ``frac`` of keys, else
    'train'; independent of partitioning and plan, unlike randomSplit."""
    h = F.pmod(hash32(F.concat_ws("|", F.lit(str(seed)), _col(key).cast("string"))), F.lit(buckets))
    return F.when(h < F.lit(int(frac * buckets)), F.lit("validation")).otherwise(F.lit("train"))
