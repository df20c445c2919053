"""Hosts in one form: the samples of the bootstring standard, Python's own codec and address types."""

import ipaddress
import random

from pyspark.sql import functions as F

from pageledger.functions import urls

#: Samples of the standard for lower-case names, plain and encoded.
SAMPLES = {
    "ليهمابتكلموشعربي؟": "egbpdaj6bu4bxfgehfvwxn",
    "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye",
    "他們爲什麽不說中文": "ihqwctvzc91f659drss3x8bo0yb",
    "なぜみんな日本語を話してくれないのか": "n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa",
    "почемужеонинеговорятпорусски": "b1abfaaepdrnnbgefbadotcwatmq2g4l",
    "3年b組金八先生": "3b-ww4c5e180e575a65lsy2b",
    "そのスピードで": "d9juau41awczczp",
}


def hosts(values, names):
    return values(urls.hostname, [f"http://{name}/" for name in names])


def test_samples_of_the_standard(values):
    assert hosts(values, [f"{name}.org" for name in SAMPLES]) == [f"xn--{code}.org" for code in SAMPLES.values()]


def test_any_label_as_the_codec_writes_it(values):
    rng = random.Random(3)
    labels = ["".join(rng.choices("abz09-äßéøıиж中文字😀", k=rng.randint(1, 20))) for _ in range(200)]
    labels = [label for label in labels if not label.isascii()]
    assert hosts(values, [f"{label}.example" for label in labels]) == [f"xn--{label.encode('punycode').decode()}.example" for label in labels]


def test_spellings_of_one_name(values):
    names = ["bücher.example", "BÜCHER.Example", "xn--bcher-kva.example", "b%C3%BCcher.example", "ｂücher。example", "bü­cher.example", "ü" * 64 + ".org", "ä" * 62 + ".org"]
    assert hosts(values, names) == ["xn--bcher-kva.example"] * 6 + [None, None]
    assert values(urls.site_key, ["https://bücher.example/a"]) == ["xn--bcher-kva.example"]


ADDRESSES = {
    "127.0.0.1": "127.0.0.1", "127.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "0x7F000001": "127.0.0.1", "2130706433": "127.0.0.1", "017700000001": "127.0.0.1",
    "1.2.3": "1.2.0.3", "1.2.3.4.": "1.2.3.4", "0x.0x.0": "0.0.0.0", "192.168.257": "192.168.1.1", "00000000000001.2.3.4": "1.2.3.4",
    "256.1.1.1": None, "1.2.3.4.5": None, "1.2.3.256": None, "4294967296": None, "4294967295": "255.255.255.255", "08.1": None, "1..2": None, "a.1": None, "a.0x": None,
    "1.2.3.09": None, "１.２.３.４": "1.2.3.4", "99999999999999999999": None, "1.256": "1.0.1.0", "1.2.3.4a": "1.2.3.4a", "0xg.com": "0xg.com", "1.2.com": "1.2.com",
}


def test_ipv4(values):
    assert dict(zip(ADDRESSES, hosts(values, list(ADDRESSES)))) == ADDRESSES


def test_ipv6(values):
    rng = random.Random(5)
    texts = ["0:0::1", "::", "1::", "::1", "2001:DB8:0:0:1:0:0:1", "1:0:0:2:0:0:0:3", "0:1:2:3:4:5:6:7", "1:2:3:4:5:6:0:0", "1:0:2:3:4:5:6:7", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "00a:0b::"]
    for _ in range(100):
        texts.append(":".join(rng.choice(["0", "0", "0000", "1", "ab", "0C0"]) for _ in range(8)))
    wrong = ["1::2::3", "1:2:3", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1", "1:", ":::", "1:2:3:4:5:6:7::8", "::1.2.3", "::1.2.3.256", "::1.2.3.4:5", "1.2.3.4"]

    def shortest(text):
        """As the type writes it, but mapped addresses in groups."""
        address = ipaddress.IPv6Address(text)
        low = int(address) & 0xFFFFFFFF
        return f"::ffff:{low >> 16:x}:{low & 0xFFFF:x}" if address.ipv4_mapped else str(address)

    assert hosts(values, [f"[{text}]" for text in texts]) == [f"[{shortest(text)}]" for text in texts]
    assert hosts(values, [f"[{text}]" for text in wrong]) == [None] * len(wrong)
    assert values(lambda u: urls.normalize_url(u, F.lit("http://x/")), ["//[0::0]:80/a", "//0x7f.1/b"]) == ["http://[::]/a", "http://127.0.0.1/b"]
