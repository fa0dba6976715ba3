"""Encoders with weights, over a tokenizer made here and a stand-in for the graph."""

from __future__ import annotations

import types

import numpy as np
import pytest

from lensmill.operators.vectors import Encoder
from lensmill.sources import onnx

tokenizers = pytest.importorskip("tokenizers")
runtime = pytest.importorskip("onnxruntime")


@pytest.fixture
def folder(tmp_path, monkeypatch):
    words = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "query:", "good", "bad", "game"])}
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel(words, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    for name in onnx.ENCODERS:
        (tmp_path / name).mkdir()
        t.save(str(tmp_path / name / "tokenizer.json"))
        (tmp_path / name / "model_fp16.onnx").write_bytes(b"graph")
    made = []

    class Session:
        """Each token's vector is its id at the place of the encoder's last axis."""

        def __init__(self, path, providers):
            made.append((path, providers))

        def get_inputs(self):
            return [types.SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

        def get_outputs(self):
            return [types.SimpleNamespace(name="hidden")]

        def run(self, outputs, given):
            assert outputs == ["hidden"] and set(given) == {"input_ids", "attention_mask"} and given["input_ids"].dtype == np.int64
            return [np.eye(8)[given["input_ids"]]]

    monkeypatch.setattr(runtime, "InferenceSession", Session)
    monkeypatch.setattr(onnx, "_sessions", {})
    return str(tmp_path), made


def test_texts_are_pooled_and_normalised(folder):
    where, made = folder
    run = onnx.forward(where)(Encoder("e5-small", 8, "mean", "query: ", 3))
    out = run(["good game", "bad", "good game game game"])
    assert out.shape == (3, 8) and np.allclose(np.linalg.norm(out, axis=1), 1)
    assert np.allclose(out[0], out[2]) and out[1][0] == 0 and out[1][4] > 0  # cut after three tokens; padding has no weight
    first = onnx.forward(where)(Encoder("gte-base", 8, "cls", "", 512))(["bad game"])
    assert first.argmax() == 4 and run([]).shape == (0, 8)
    assert len(made) == 2 and made[0][1] == ["CPUExecutionProvider"]


def test_files_must_be_the_pinned_ones(folder):
    where, _ = folder
    with pytest.raises(ValueError, match="not the pinned file"):
        onnx.check(where, "e5-small", "fp16")
    assert not onnx.files_of(where, "e5-small", "fp16")[0].exists()
    with pytest.raises(ValueError, match="fp16, fp32"):
        onnx.files_of(where, "e5-small", "int8")
    assert set(onnx.ENCODERS) == set(onnx.WEIGHTS)
