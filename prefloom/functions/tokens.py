"""Tokenizers as column functions.

`CodepointTokenizer` maps text to its Unicode code points with native Spark
expressions, so an encoding job stays in the JVM and has an exact SQL
oracle.  `ArrowTokenizer` plugs in any Python tokenizer through an
Arrow-batched pandas UDF; the tokenizer object is built once per Python
worker process, whatever the number of tasks it runs.

Each piece of text is tokenized on its own (role name, message, system
message), never the joined string.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The loss-ignore label id of the training library.
IGNORE_INDEX = -100

# Fixed values (ours): special ids of the code-point tokenizer, just above
# the largest code point U+10FFFF.
CP_IM_START = 0x110000  # 1114112
CP_IM_END = 0x110001  # 1114113
CP_EOD = 0x110002  # 1114114


def int_array(values: list[int]) -> Column:
    if not values:
        return F.array().cast("array<int>")
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


@dataclass(frozen=True)
class CodepointTokenizer:
    im_start_id: int = CP_IM_START
    im_end_id: int = CP_IM_END
    eod_id: int = CP_EOD

    def encode(self, text: Column) -> Column:
        """array<int> of code points; empty text gives [] (not [0])."""
        cps = F.transform(F.split(text, ""), lambda ch: F.ascii(ch))
        return F.when(text == "", F.array().cast("array<int>")).otherwise(cps.cast("array<int>"))

    def encode_const(self, text: str) -> list[int]:
        return [ord(ch) for ch in text]

    def encode_many(self, texts: Column) -> Column:
        """array<string> -> array<array<int>>."""
        return F.transform(texts, lambda t: self.encode(t))

    def role_ids(self, role: str) -> list[int]:
        """Ids of the header `<|im_start|>{role}`: the special token, then the name."""
        return [self.im_start_id] + self.encode_const(role)

    @property
    def pad_token_id(self) -> int:
        return self.eod_id

    @property
    def eos_token_id(self) -> int:
        return self.eod_id


_built: dict[str, object] = {}


def built_once(key: str, factory: Callable[[], object]) -> object:
    """The tokenizer of this process: module state outlives a task, a UDF's closure does not."""
    if key not in _built:
        _built[key] = factory()
    return _built[key]


@dataclass(frozen=True)
class ArrowTokenizer:
    """Wrap a Python tokenizer built by `factory()` on each worker.

    `encode_fn(tok, texts)` maps a list of strings to a list of id lists.
    Special ids are given explicitly.
    """

    factory: Callable[[], object]
    encode_fn: Callable[[object, list[str]], list[list[int]]]
    im_start_id: int
    im_end_id: int
    eod_id: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _pandas_udf(self):
        key, factory, encode_fn = self.key, self.factory, self.encode_fn

        @F.pandas_udf("array<int>")
        def _enc(texts):  # pandas.Series -> pandas.Series
            import pandas as pd

            tok = built_once(key, factory)
            mask = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if mask.any():
                ids = encode_fn(tok, texts[mask].tolist())
                out[mask] = pd.Series([list(map(int, x)) for x in ids], index=texts[mask].index, dtype=object)
            return out

        return _enc

    def encode(self, text: Column) -> Column:
        return self._pandas_udf()(text)

    def encode_many(self, texts: Column) -> Column:
        """array<string> -> array<array<int>>, one UDF call per Arrow batch of rows."""
        key, factory, encode_fn = self.key, self.factory, self.encode_fn

        @F.pandas_udf("array<array<int>>")
        def _enc_many(lists):  # pandas.Series of arrays -> pandas.Series of arrays of arrays
            import pandas as pd

            tok = built_once(key, factory)
            flat, sizes = [], []
            for lst in lists:
                items = [] if lst is None else list(lst)
                sizes.append(None if lst is None else len(items))
                flat.extend("" if x is None else x for x in items)
            ids = encode_fn(tok, flat) if flat else []
            out, i = [], 0
            for n in sizes:
                if n is None:
                    out.append(None)
                    continue
                out.append([list(map(int, x)) for x in ids[i : i + n]])
                i += n
            return pd.Series(out, index=lists.index, dtype=object)

        return _enc_many(texts)

    def encode_const(self, text: str) -> list[int]:
        tok = built_once(self.key, self.factory)
        return [int(x) for x in self.encode_fn(tok, [text])[0]]

    def role_ids(self, role: str) -> list[int]:
        return [self.im_start_id] + self.encode_const(role)

    @property
    def pad_token_id(self) -> int:
        return self.eod_id

    @property
    def eos_token_id(self) -> int:
        return self.eod_id
