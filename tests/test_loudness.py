import math

import numpy as np
import pytest

from tonearm.operators import loudness as L


def plain(channels, rate):
    """Integrated loudness and range, sample by sample and window by window."""
    y = [np.array(L.filtered(list(c), rate)) for c in channels]
    tenths = [[(c[-(-k * rate // 10) : -(-(k + 1) * rate // 10)] ** 2).mean() for k in range(math.ceil(len(c) * 10 / rate))] for c in y]
    z = np.sum([np.array(t) * (0 if i == 3 else 1.41 if i > 3 else 1) for i, t in enumerate(tenths)], axis=0)
    level = lambda e: -0.691 + 10 * math.log10(e) if e > 0 else -1e9
    def gated(size, relative):
        w = [z[k : k + size].mean() for k in range(len(z) - size + 1)]
        w = [e for e in w if level(e) > -70]
        return [e for e in w if level(e) > level(np.mean(w)) + relative] if w else []
    moments, shorts = gated(4, -10), [level(e) for e in gated(30, -20)]
    return (level(np.mean(moments)) if moments else None), (np.percentile(shorts, 95) - np.percentile(shorts, 10) if shorts else None)


def test_filter_coefficients_of_the_standard():
    (b1, a1), (b2, a2) = L.biquads(48000)
    assert np.allclose(b1, [1.53512485958697, -2.69169618940638, 1.19839281085285]) and np.allclose(a1[1:], [-1.69065929318241, 0.73248077421585])
    assert np.allclose(b2, [1, -2, 1]) and np.allclose(a2[1:], [-1.99004745483398, 0.99007225036621])


@pytest.mark.parametrize("rate", [8000, 11025])
def test_loudness_equals_a_plain_version(spark, rate):
    r = np.random.default_rng(3)
    t = np.arange(int(6.35 * rate)) / rate
    swell = np.where(t < 2, 0.02, np.where(t < 4, 0.5, 0.1))
    tracks = {
        "stereo": [swell * np.sin(2 * np.pi * 440 * t), swell * r.standard_normal(len(t)) * 0.1], "six": [0.1 * r.standard_normal(len(t)) for _ in range(6)], "silent": [np.zeros(len(t))], "short": [np.sin(t[: rate // 4])],
    }
    rows = []
    for name, channels in tracks.items():
        for c, x in enumerate(channels):
            at, block = 0, 0
            while at < len(x):  # blocks of any length
                n = int(r.integers(1, rate))
                rows.append((name, c, block, rate, x[at : at + n].tolist()))
                at, block = at + n, block + 1
    rows += [("stereo", 0, 999, rate, []), ("none", 0, 0, None, [1.0])]
    frame = spark.createDataFrame(rows, "track string, channel int, block int, rate int, samples array<double>").repartition(5)
    got = {x["track"]: x for x in L.loudness(frame).collect()}
    for name, channels in tracks.items():
        want = plain(channels, rate)
        for value, key in zip(want, ("integrated", "loudness_range")):
            assert (got[name][key] is None) == (value is None) and (value is None or abs(got[name][key] - value) < 1e-5)
    assert got["none"]["integrated"] is None and got["stereo"]["seconds"] == 6.4


def test_full_scale_tone_is_minus_three(spark):
    """A 997 Hz tone at full scale on one channel reads -3.01 LUFS."""
    rate = 48000
    x = np.sin(2 * np.pi * 997 * np.arange(rate * 2) / rate)
    frame = spark.createDataFrame([(1, 0, i, rate, x[i * 9600 : (i + 1) * 9600].tolist()) for i in range(10)], "track int, channel int, block int, rate int, samples array<float>")
    assert abs(L.loudness(frame).first()["integrated"] + 3.01) < 0.01
