"""Encoders with weights: ONNX graphs and tokenizers from a folder, checked against their pinned digests.

Nothing is downloaded. ``forward`` plugs into ``vectors.embedded`` and ``vectors.embed_reviews``; the
session is made once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from lensmill.operators.vectors import Encoder, pool
from lensmill.sources.files import verified


@dataclass(frozen=True)
class Weights:
    """Where an encoder's files come from and what they must hash to: the graph in each precision, and the tokenizer."""

    source: str
    graph: dict[str, str]
    tokenizer: str


#: Published encoders with their width, pooling and prefix; tokens read of a text.
ENCODERS = {
    "e5-small": Encoder("e5-small", 384, "mean", "query: ", 512),
    "e5-base": Encoder("e5-base", 768, "mean", "query: ", 512),
    "arctic-m-v2": Encoder("arctic-m-v2", 768, "cls", "", 512),
    "gte-base": Encoder("gte-base", 768, "cls", "", 512),
}
#: Where each is published, and SHA-256 digests of its graph in each precision and of its tokenizer.
WEIGHTS = {
    "e5-small": Weights(
        "intfloat/multilingual-e5-small",
        {"fp16": "4654c156f3e4171abc9c716cdb771bf9116455d15ac1aab364aeeede0e3205b0", "fp32": "ca456c06b3a9505ddfd9131408916dd79290368331e7d76bb621f1cba6bc8665"},
        "0b44a9d7b51c3c62626640cda0e2c2f70fdacdc25bbbd68038369d14ebdf4c39",
    ),
    "e5-base": Weights(
        "intfloat/multilingual-e5-base",
        {"fp16": "f60256a833caee5c75a3903e589116752ee016ca7bc16f9b96e4db09984c5703", "fp32": "84a4d426f7e87a6bf5bf195f0bae2c4a7d15f675b23ca96f42fab8326d7a77aa"},
        "62c24cdc13d4c9952d63718d6c9fa4c287974249e16b7ade6d5a85e7bbb75626",
    ),
    "arctic-m-v2": Weights(
        "Snowflake/snowflake-arctic-embed-m-v2.0",
        {"fp16": "f27ab40ab6e230265ba49a202a37f1ad031556256cbbc105d0ca9c0bdc7ec42e", "fp32": "c0c53d7f49a2db60761b92b7bbf5be87a7b3cf5d92dbbd7f1b5028bd5a40aa39"},
        "f1cc44ad7faaeec47241864835473fd5403f2da94673f3f764a77ebcb0a803ec",
    ),
    "gte-base": Weights(
        "onnx-community/gte-multilingual-base",
        {"fp16": "f1d0f4ec988a6c17387d3b256e631deea506a891aed3a6ded4f9bf09386cc38e", "fp32": "5b9f03fdc40350a78fa064b4cfb6bf9a229a7c40aa87736f537e3ebd00aa2b86"},
        "3a56def25aa40facc030ea8b0b87f3688e4b3c39eb8b45d5702b3a1300fe2a20",
    ),
}
_sessions: dict[tuple, tuple] = {}


def files_of(folder: str, name: str, precision: str) -> tuple[Path, Path]:
    """Graph and tokenizer of an encoder below ``folder``; refuses a precision that is not published."""
    if precision not in WEIGHTS[name].graph:
        raise ValueError(f"{name} comes in {', '.join(WEIGHTS[name].graph)}, not {precision}")
    return Path(folder) / name / f"model_{precision}.onnx", Path(folder) / name / "tokenizer.json"


def check(folder: str, name: str, precision: str) -> None:
    """Raises unless the files are the pinned ones; a file that is not is deleted."""
    graph, tokenizer = files_of(folder, name, precision)
    verified(graph, WEIGHTS[name].graph[precision])
    verified(tokenizer, WEIGHTS[name].tokenizer)


def _session(folder: str, encoder: Encoder, precision: str) -> tuple:
    key = folder, encoder.name, precision
    if key not in _sessions:
        import onnxruntime
        from tokenizers import Tokenizer

        graph, tokens = files_of(folder, encoder.name, precision)
        there = onnxruntime.get_available_providers()
        best = [p for p in ("CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider") if p in there]
        tokenizer = Tokenizer.from_file(str(tokens))
        tokenizer.enable_padding()
        if encoder.most_tokens:
            tokenizer.enable_truncation(encoder.most_tokens)
        session = onnxruntime.InferenceSession(str(graph), providers=best)
        # what a graph asks for differs between exports of one model
        _sessions[key] = session, tokenizer, {i.name for i in session.get_inputs()}, session.get_outputs()[0].name
    return _sessions[key]


def forward(folder: str, precision: str = "fp16") -> Callable[[Encoder], Callable[[list[str]], np.ndarray]]:
    """What ``vectors.embedded`` takes as its ``forward``: unit vectors of texts by the encoder's graph."""

    def load(encoder: Encoder) -> Callable[[list[str]], np.ndarray]:
        def run(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros((0, encoder.dimensions), dtype=np.float32)
            session, tokenizer, wanted, output = _session(folder, encoder, precision)
            encoded = tokenizer.encode_batch([encoder.prefix + t for t in texts])
            ids, mask = (np.array([getattr(e, what) for e in encoded], dtype=np.int64) for what in ("ids", "attention_mask"))
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            hidden = session.run([output], {k: v for k, v in given.items() if k in wanted})[0]
            return pool(np.asarray(hidden, dtype=np.float32), mask, encoder.pooling)

        return run

    return load
