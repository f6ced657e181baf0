"""Token ids of whole texts with a public tokenizer file, remembered per word."""

from __future__ import annotations

from array import array

#: Some white space for Python is none for the tokenizer; texts with it are encoded in one go.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds(dict):
    """Little-endian 32-bit ids by word. Encoding a text is joining its words' ids, because the tokenizer (which the
    constructor checks) drops white space and never merges across it; a word not seen before is encoded by the
    library. At about ``limit`` bytes the memory starts anew, so a long-lived worker stays bounded."""

    def __init__(self, path: str, limit: int = 160 << 20):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize  # every look at ``model`` makes a new object
        self.limit, self.size = limit, 0
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        dropped = any(c["type"] == "Split" and c["behavior"] == "Removed" and c["invert"] and "[^\\s\\p{L}\\p{N}]+" in c["pattern"].get("Regex", "") for c in cuts)
        self.by_word = dropped and {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"}
        self.plain_letters = self.by_word and "Lowercase" in {x["type"] for x in steps} and cuts[-1]["type"] == "ByteLevel"
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.size >= self.limit:
            self.clear()
            self.size = 0
        if self.plain_letters and word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            # Latin-1 letters only: one piece for the model, with no other normalisation than the case
            low = word.lower()
            piece = low if low.isascii() else self.as_bytes.pre_tokenize_str(low)[0][0]
            ids = array("I", [t.id for t in self.pieces(piece)]).tobytes()
        else:
            core = word.rstrip(_TAIL)
            if self.plain_letters and core != word and core.isalpha():
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = self.whole(word)
        if len(word) <= 256:  # a longer one hardly comes again
            self[word] = ids
            self.size += 160 + len(word) + len(ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(c in text for c in _ODD):
            return self.whole(text)
        if self.plain_letters and "<|" not in text and _latin(text):
            text = text.lower()  # letter by letter here, as the tokenizer would
        return b"".join([self[w] for w in text.split()])


def word_ids(path: str) -> WordIds:
    """The worker process's own memory for this tokenizer file. Functions travel to workers by value, so it is kept with
    the interpreter's modules, where the next task of the same worker finds it."""
    import os
    import sys
    import types

    held = sys.modules.setdefault("packetloom_worker_memory", types.ModuleType("packetloom_worker_memory")).__dict__
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held[path] = WordIds(path)
    return held[path]
