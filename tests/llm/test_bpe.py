from inkstream.llm.bpe import standard_codec


def test_a_pre_token_is_merged_once_whatever_stands_beside_it():
    codec, merged = standard_codec(), []
    plain = codec.merged
    codec.merged = lambda token: merged.append(token) or plain(token)
    texts = [f"thhaanendble{mark} zzz thhaanendble{mark}" for mark in ("", ",", ".", "!", "?", ";")] + ["", "  a  b", " ", "\n x", "é ß"]
    ids, offsets = codec.encode_all(texts)
    assert len(merged) == len(set(merged)) and b" thhaanendble" in merged
    assert codec.decode_all(ids, offsets).to_pylist() == [x.encode() for x in texts]
    one_by_one = [codec.encode_all([x])[0].tolist() for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == one_by_one


def test_no_texts():
    codec = standard_codec()
    ids, offsets = codec.encode_all([])
    assert len(ids) == 0 and offsets.tolist() == [0] and codec.decode_all(ids, offsets).to_pylist() == []
