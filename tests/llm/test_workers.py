"""What a Python worker keeps between the tasks of different stages."""

from ledgerloom.llm import bpe_tree, common


def test_a_stage_starts_without_the_models_of_others(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(common, "_KEPT", {})
    bpe_tree.load(public_tokenizers.path("word_bpe_49k.json"))
    assert list(common.thrifty(iter, "bpe")([1, 2])) == [1, 2] and bpe_tree._LOADED
    assert list(common.thrifty(iter, "pii")([3])) == [3] and not bpe_tree._LOADED
