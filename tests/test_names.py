import base64
import posixpath
import random
import unicodedata
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from boxloom.functions import labels as L
from boxloom.functions import names as N


def told(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_source_names(spark):
    same = ["video1_2", " VIDEO1_2", "video1-2_jpg", "video1 2_JPEG_jpg.rf.0A1B.JPG", "video１_２.jpg", chr(160) + "video1_2_png\t", "video1_2\n"]
    assert set(told(spark, N.source_name, same)) == {"video1_2"}
    assert told(spark, N.source_name, ["pexo_1_png2", "fog_jpgset", "hill_1_2", "_jpg", "", " ", None, "N/A", "-"]) == ["pexo_1_png2", "fog_jpgset", "hill_1_2", None, None, None, None, None, None]


def test_group_names(spark):
    same = ["explicit_video:video1", "Explicit-Video:Video1", " explicit_video : video1 ", "EXPLICIT VIDEO: VIDEO1"]
    assert set(told(spark, N.plain_name, same)) == {"explicit_video:video1"}


def test_splits(spark):
    assert told(spark, N.usable_split, [" Train", "training", "train/", "VAL ", "validation", "TEST", "testing", "?", "", None, "trainer"]) == ["train", "train", "train", "valid", "valid", "test", "test", None, None, None, None]


def test_digests(spark):
    raw = bytes(range(32))
    h = raw.hex()
    notations = [h, h.upper(), f"0x{h}", f"sha256:{h}", f"SHA-256 = {h.upper()}", ":".join(h[i : i + 2] for i in range(0, 64, 2)), base64.b64encode(raw).decode(), f" {h}\n", base64.urlsafe_b64encode(raw).decode().rstrip("=")]
    assert set(told(spark, N.digest_hex, notations)) == {h}
    assert told(spark, N.digest_hex, [h[:16], h[:15], "", None, "nothing", h + "0"]) == [h[:16], None, None, None, None, None]


def test_paths(spark):
    random.seed(3)
    steps = ["a", "b c", "d_1", ".", "..", "", "e%20f", "g+h", "..x"]
    paths = ["/".join(random.choice(steps) for _ in range(random.randint(1, 7))) for _ in range(300)]
    want = []
    for p in paths:
        # what is above the root counts, leading slashes do not
        q = posixpath.normpath(unquote(p).lstrip("/") or ".") if p else "."
        want.append("" if q == "." else q)
    assert told(spark, N.tidy_path, paths) == want
    assert told(spark, N.tidy_path, ["a\\b\\c.txt", " a//b \n", "a%5Fb", "100%/x", "a%2Fb"]) == ["a/b/c.txt", "a/b", "a_b", "100%/x", "a/b"]


def test_composed_letters(spark):
    random.seed(4)
    letters = [chr(c) for c in (*range(0xC0, 0x180), 0x1EC7, 0x1EA5, 0x3AC, 0x439, 0x212B, 0x41, 0x7A)]
    texts = ["".join(random.choice(letters) for _ in range(8)) for _ in range(60)]
    mixed = [unicodedata.normalize(random.choice(["NFC", "NFD"]), t) for t in texts] + ["e\u0302\u0323", "\u0301a", "", None]
    assert told(spark, N.composed, mixed) == [t if t is None else unicodedata.normalize("NFC", t) for t in mixed]
    assert len(set(told(spark, N.tidy_path, ["d/d\u00e4cher.txt", "d//da\u0308cher.txt", "d/d%C3%A4cher.txt", "d/da%CC%88cher.txt"]))) == 1


def test_label_paths(spark):
    assert told(spark, N.label_path_of, ["d/train/images/x.y.jpg", "images/a/images/b.png", "images/a.png", "d/pics/a.png"]) == ["d/train/labels/x.y.txt", "images/a/labels/b.txt", "labels/a.txt", "d/pics/a.txt"]


def test_label_text(spark):
    cases = {"": True, "0 .1 .2 .3 .4": True, "0.0\t0.1  0.2 1e-3 4\r\n": True, "0 .1 .2 .3": False, "0 nan .2 .3 .4": False, "x": False, "0 .1 .2 .3 .4\n\n 1 1 1 1 1": True, "0 .1 .2 .3 .4 .5": False}
    assert told(spark, L.usable_signature, [*cases, None]) == [*cases.values(), False]
    boxes = told(spark, L.boxes_of, ["1 .5 .5 .1 .1\n0 .2 .2 .1 .1", "", None])
    assert [b["x"] for b in boxes[0]] == [0.2, 0.5] and boxes[1:] == [[], None]
    assert told(spark, L.good_line_count, ["0 1 1 1 1\nx\n0 1 1 1 1", None]) == [2, 0]
