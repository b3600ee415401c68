import pytest

from scholarmetrics import Config


def test_validates():
    with pytest.raises(ValueError):
        Config(min_year=2020, max_year=2019)
    with pytest.raises(ValueError):
        Config(edition="2018")
    with pytest.raises(ValueError):
        Config(top_frac=0)
    with pytest.raises(ValueError):
        Config(percentiles=(1.5,))


def test_labels_and_fingerprint():
    c = Config(min_year=1960, min_cite_year=1996, max_year=2019)
    assert (c.y1, c.y2, c.y3) == ("60", "96", "19")
    assert c.fingerprint() != c.with_(min_cite_year=2019).fingerprint()
    assert c.fingerprint() == c.with_(name="other").fingerprint()
    assert c.fingerprint("min_year") == c.with_(top_n=5).fingerprint("min_year") != c.with_(min_year=1970).fingerprint("min_year")
