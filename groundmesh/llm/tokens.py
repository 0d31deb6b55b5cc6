"""Token ids of whole texts by a public word-BPE file, with the ids of words that came before kept per worker.

The file's normalizer (NFC, white space to blanks, lower case) and splitter never cross white space, so a text's ids
are those of its white-space chunks one after the other. Each Python worker keeps the ids of chunks it has met (up to
``CACHED_CHUNKS``) and hands the others to the BPE model in long strings: words end where an id's token ends in the
end-of-word suffix. Results equal ``Tokenizer.encode(text, add_special_tokens=False)`` on the whole text: one that holds the text
of an added token goes through it as is, and so do files of another shape.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

CACHED_CHUNKS = 500_000
JOINED_WORDS = 2000
#: White space to str.split() but not to the tokenizer: texts with them go through the tokenizer as they are.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself where visible in Latin-1, else 256 upwards."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    added = spec.get("added_tokens") or []
    if any(x.get("normalized") for x in added) or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["model"].get("end_of_word_suffix") != "</w>":
        plain_file = Tokenizer.from_file(path)
        return lambda texts: [np.array(x.ids, dtype=np.int64) for x in plain_file.encode_batch_fast(texts, add_special_tokens=False)]

    vocab = spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    whole = Tokenizer.from_file(path)
    odd_parts = regex.compile("|".join([SEPARATORS.pattern, *(regex.escape(x["content"]) for x in added)]))
    model = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>", cache_capacity=0))
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    parts = regex.compile(steps[0]["pattern"]["Regex"])
    letters = byte_letters()
    # what the cache holds: a chunk's place in ``starts``; its ids are flat[starts[i]:starts[i + 1]]
    cache: dict[str, int] = {}
    store = {"flat": np.zeros(1 << 20, dtype=np.uint16 if len(ends) <= 1 << 16 else np.uint32), "starts": np.zeros(1 << 18, dtype=np.int64)}

    def grow(name: str, size: int) -> np.ndarray:
        if size > len(store[name]):
            store[name] = np.concatenate([store[name], np.zeros(max(size - len(store[name]), len(store[name])), dtype=store[name].dtype)])
        return store[name]

    def learn(chunks: list[str]) -> None:
        words: dict[str, int] = {}
        pieces = []
        for chunk in chunks:
            if not chunk.isascii():
                chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
            # letters alone, or with one stop at their end, need no splitter
            chunk = chunk.lower()
            if chunk.isalpha():
                found = [chunk]
            elif chunk[-1] in ".," and chunk[:-1].isalpha():
                found = [chunk[:-1], chunk[-1]]
            else:
                found = parts.findall(chunk)
            pieces.append([words.setdefault(w, len(words)) for w in found])
        plain = [w.encode("utf-8").decode("latin-1").translate(letters) for w in words]
        joined = [" ".join(plain[i : i + JOINED_WORDS]) for i in range(0, len(plain), JOINED_WORDS)]
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(e.ids, dtype=np.int64) for e in model.encode_batch_fast(joined, add_special_tokens=False))])
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer file does not mark every word's end")
        begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        at = len(cache)
        starts = grow("starts", at + len(chunks) + 1)
        end = int(starts[at])
        order = np.fromiter((i for p in pieces for i in p), dtype=np.int64)
        sizes = stops - begins
        lengths = np.fromiter((sum(sizes[i] for i in p) for p in pieces), dtype=np.int64, count=len(pieces))
        starts[at + 1 : at + 1 + len(chunks)] = end + np.cumsum(lengths)
        flat = grow("flat", int(starts[at + len(chunks)]))
        flat[end : starts[at + len(chunks)]] = gather(ids, begins[order], sizes[order])
        cache.update((c, at + i) for i, c in enumerate(chunks))

    def encode(texts: list[str]) -> list[np.ndarray]:
        room = len(cache) < CACHED_CHUNKS
        odd = {i for i, t in enumerate(texts) if odd_parts.search(t)}
        split = [[] if i in odd else t.split() for i, t in enumerate(texts)]
        fresh = list(set().union(*split).difference(cache))
        if fresh:
            learn(fresh)
        flat, starts, out = store["flat"], store["starts"], []
        for i, chunks in enumerate(split):
            if i in odd:
                out.append(np.array(whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.int64))
                continue
            places = np.fromiter(map(cache.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            out.append(gather(flat, starts[places], starts[places + 1] - starts[places]))
        if not room:  # the cache is full: what was new stays for this call only
            for chunk in fresh:
                del cache[chunk]
        return out

    return encode


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[b:b + s] for each begin and size, one after the other."""
    if not len(sizes):
        return values[:0]
    total = np.cumsum(sizes)
    return values[np.arange(total[-1]) + np.repeat(begins - total + sizes, sizes)]


def load_encoder(path: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """For use inside tasks: the encoder is built once per Python worker."""
    return functools.partial(word_encoder, path)
