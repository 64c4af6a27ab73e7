"""The last bytes of a text go through the PNG filters, too."""

from foliospark.functions import predictor
from foliospark.plans import queries as plans


def test_no_byte_is_left_out(monkeypatch):
    met, encode = [], predictor.encode_png_best
    monkeypatch.setattr(plans, "table", lambda *_: None)
    monkeypatch.setattr(plans, "_each", lambda rows, key, column, kernel: kernel)
    monkeypatch.setattr(predictor, "encode_png_best", lambda data, *a: (met.append(data), encode(data, *a))[1])
    kernel = plans.png_filter_roundtrip(None, "")
    for n in (0, 1, 23, 24, 25, 71):
        data = bytes(range(1, n + 1))
        assert kernel(data) == [(True, True)]
        assert met[-1].startswith(data) and len(met[-1]) == -(-n // 24) * 24
