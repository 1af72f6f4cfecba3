"""Images: sources, kernels, quality, preprocessing, the whole run, sinks and streams. Files are written by hand."""

import os
import sqlite3
import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators import decode, encode, kernels, regions
from docweave.operators.ocr import NOT_STARTED, ON_CPU, ON_GPU, FunctionBackend, TokenTableBackend, resource_profile, see_files
from docweave.plans.engine import Engine
from docweave.schemas import TOKENS
from docweave.sources import images, sinks, sqlite


def png(x):
    h, w = x.shape[:2]
    body = b"".join(b"\0" + x[k, :, ::-1].tobytes() for k in range(h))
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(body, 1)) + part(b"IEND", b"")


def page(h=400, w=800):
    """Black strokes like letters on white."""
    x = np.full((h, w, 3), 255, np.uint8)
    for row in range(60, h - 60, 50):
        for col in range(80, w - 100, 26):
            x[row : row + 24, col : col + 4] = 0
            x[row : row + 4, col : col + 14] = 0
            x[row + 20 : row + 24, col : col + 14] = 0
    return x


def judged(spark, x):
    import pandas as pd

    from docweave.operators import quality

    m = pd.DataFrame([kernels.measure(x)])
    return quality.combine(quality.scores(spark.createDataFrame(m))).first()


def test_clear_blurred_pale_and_blank(spark):
    clear = judged(spark, page())
    assert clear.status == "ACCEPTED" and clear.score >= 70 and clear.sharpness_score >= 70 and clear.contrast_score >= 70 and clear.reasons == []
    blurred = judged(spark, kernels.blur(page(), 6.0, 31))
    assert blurred.status == "REJECTED" and (blurred.sharpness_score < 70 or blurred.reasons)
    pale = judged(spark, np.clip(128 + 0.05 * (page().astype(float) - 128), 0, 255).astype(np.uint8))
    assert pale.status == "REJECTED" and pale.reasons
    blank = judged(spark, np.full((400, 800, 3), 240, np.uint8))
    assert blank.status == "REJECTED" and any("Densité" in r or "Netteté" in r or "Contraste" in r for r in blank.reasons)


def test_components_touch_at_corners():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0], [0, 0, 1, 1]], bool)
    labels, n = kernels.components(m)
    assert n == 3 and labels[0, 0] == labels[1, 1] == labels[2, 0] and labels[0, 3] == labels[1, 3] != labels[3, 3]
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((15, 17)) < 0.45
        labels, n = kernels.components(m)
        seen, parts = np.zeros_like(m), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            parts += 1
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                cells.append(labels[a, b])
                for c in range(max(0, a - 1), min(15, a + 2)):
                    for d in range(max(0, b - 1), min(17, b + 2)):
                        if m[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            assert len(set(cells)) == 1
        assert parts == n


def tiled(spark, pages, h, w):
    rows = []
    for k, m in enumerate(pages):
        for y in range(0, m.shape[0], h):
            for x in range(0, m.shape[1], w):
                t = m[y : y + h, x : x + w]
                rows.append((k, y, x, *t.shape, t.astype(np.uint8).tobytes()))
    return spark.createDataFrame(rows, "id long, y0 int, x0 int, height int, width int, mask binary").repartition(3)


@pytest.mark.parametrize("corners", [True, False])
def test_regions_over_tiles_equal_the_whole(spark, corners):
    rng = np.random.default_rng(4)
    spiral = np.zeros((31, 31), bool)  # one part that goes through all tiles many times
    y = x = 0
    for n, (dy, dx) in zip([30, 30, 30, 28, 28, 26, 26, 24, 24, 22, 22, 20, 20, 18, 18, 16, 16], [(0, 1), (1, 0), (0, -1), (-1, 0)] * 5, strict=False):
        for _ in range(n):
            spiral[y, x] = True
            y, x = y + dy, x + dx
    pages = [rng.random((31, 31)) < p for p in (0.1, 0.3, 0.42, 0.6, 0.9)] + [np.zeros((5, 5), bool), np.ones((31, 31), bool), spiral]
    for h, w in ((7, 7), (31, 31), (4, 13)):
        got = regions.regions(tiled(spark, pages, h, w), corners).collect()
        for k, m in enumerate(pages):
            labels, n = kernels.components(m, corners)
            want = sorted(map(tuple, kernels.boxes(labels, n).tolist()))
            assert sorted((r.x, r.y, r.width, r.height, r.area) for r in got if r.id == k) == want
    ink = kernels.gray(page()) < 128
    labels, n = kernels.components(ink)
    got = regions.char_heights(tiled(spark, [ink], 64, 100), ink.size).first().char_height
    assert got == kernels.median_height(*kernels.boxes(labels, n)[:, 2:].T, ink.size) == 24


def test_geometry():
    x = page()
    assert kernels.resize(x, 1200, 600).shape == (600, 1200, 3) and kernels.resize(np.full((9, 7, 3), 77, np.uint8), 3, 4).min() == 77
    assert kernels.resize_if_needed(x).shape[1] == 1200 and max(kernels.fit_side(x, 400).shape) == 400
    turned = kernels.rotate(x, 4.0)
    assert abs(abs(kernels.skew_angle(kernels.gray(turned))) - 4.0) < 0.5 and abs(kernels.skew_angle(kernels.gray(kernels.deskew(turned)))) < 0.5
    framed = np.zeros((600, 900, 3), np.uint8)
    framed[150:450, 200:626] = 255
    assert kernels.crop_document(framed).shape[0] < 400
    assert kernels.preprocess(x, 20, 20, EngineConfig()).shape[1] >= 1200 and kernels.preprocess(x, 100, 100, EngineConfig(fast_mode=True)) is x
    lab = kernels._from_lab(kernels._lab(x[:5, 78:90]))
    assert np.abs(lab.astype(int) - x[:5, 78:90]).max() <= 1


def test_orientation():
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda"
    assert kernels.orientation(jpeg) == 6 and kernels.orientation(b"\x89PNG") == 1
    assert kernels.upright(np.zeros((2, 5, 3), np.uint8), 6).shape == (5, 2, 3)


def test_skew_uses_all_edge_points(monkeypatch):
    edges = np.zeros((1000, 1000), bool)
    edges[::4] = True  # 250,000 points
    used, count = set(), np.bincount
    monkeypatch.setattr(kernels, "canny", lambda *a: edges)
    monkeypatch.setattr(kernels.np, "bincount", lambda x, *a, **k: used.add(len(x)) or count(x, *a, **k))
    assert kernels.skew_angle(np.zeros((1000, 1000), np.uint8)) == 0.0 and used == {250_000}


def test_orientation_behind_long_segments(spark, tmp_path):
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    long = (b"\xff\xe2" + struct.pack(">H", 65_535) + bytes(65_533)) * 2
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + long + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda")
    assert [r.orientation for r in images.read_images(spark, str(tmp_path)).collect()] == [6]


def test_colour_masks():
    x = np.full((4, 4, 3), 255, np.uint8)
    x[0], x[1] = (200, 60, 20), (10, 10, 10)
    keys, values = kernels.colour_masks(x)
    assert (keys[0] == 0).all() and (keys[1:] == 255).all() and (values[1] == 0).all() and (values[0] == 255).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("scans")
    (top / "sub").mkdir()
    (top / "a.png").write_bytes(png(page()))
    (top / "sub" / "B.PNG").write_bytes(png(np.full((300, 400, 3), 240, np.uint8)))
    (top / "broken.jpg").write_bytes(b"no image")
    (top / "note.txt").write_text("x")
    return top


def test_listing(spark, folder):
    assert [r.path.rsplit("/", 1)[1] for r in images.list_images(spark, str(folder)).collect()] == ["a.png", "broken.jpg", "B.PNG"]
    with pytest.raises(FileNotFoundError):
        images.list_images(spark, str(folder / "none"))


def test_run_gates_before_recognition_and_keeps_errors(spark, folder, tmp_path):
    full = [("Nom", 0, 0), ("HUMBERT", 200, 0), ("Prenom", 0, 40), ("FLAVIEN", 200, 40), ("Nationality", 0, 80), ("BELGE", 200, 80), ("Passport No", 0, 120), ("X1234567", 200, 120)]

    def make():
        def read(image):
            assert image.shape[1] <= 960
            return [(t, 0.9, [[x, y], [x + 60.0, y], [x + 60.0, y + 20.0], [x, y + 20.0]]) for t, x, y in ((t, float(x), float(y)) for t, x, y in full)]

        return read

    rows = Engine(spark, FunctionBackend(make)).run(str(folder)).collect()
    assert [(r.image, r.status.split(":")[0]) for r in rows] == [("a.png", "SUCCESS"), ("B.PNG", "REJECTED"), ("broken.jpg", "ERROR")]
    assert rows[0].nom == "HUMBERT" and rows[0].numero_document == "X1234567" and rows[1].nom is None
    table = spark.createDataFrame([], "path string, " + TOKENS.split(", ", 1)[1])
    assert {r.failure_code for r in Engine(spark, TokenTableBackend(table)).run(str(folder)).collect()} == {"REJECTED_UNCLEAR_KEYS", None}
    result = spark.createDataFrame([(r.image, r.status, r.nom) for r in rows], "image string, status string, nom string")
    assert sinks.write_csv(result, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfimage;status;nom\r\n") and text.decode("utf-8-sig").splitlines()[1] == "a.png;SUCCESS;HUMBERT"
    assert text.decode().splitlines()[2].endswith(";REJECTED;")
    assert not sinks.write_csv(result.limit(0), str(tmp_path / "none"))
    seen, count = sinks.observed(result)
    seen.collect()
    assert count.get == {"images": 3, "successes": 1}


def maker(dark=None):
    """A recogniser that finds one label; with ``dark`` it fails where the image is darker in its corner. Nested, so that it is sent by value."""
    def make():
        def read(image):
            if dark is not None and image[1, 1, 0] < dark:
                raise RuntimeError("no tensor")
            return [("Nom", 0.9, [[0, 0], [60, 0], [60, 20], [0, 20]])]

        return read

    return make


def test_an_image_that_cannot_be_read_is_one_error_row(spark, tmp_path):
    for k in range(4):
        x = page()
        x[:4, :4] = k * 50
        (tmp_path / f"{k}.png").write_bytes(png(x))
    (tmp_path / "cut.png").write_bytes(png(page())[:60])

    engine = Engine(spark, FunctionBackend(maker(40), EngineConfig(fast_mode=True)), EngineConfig(fast_mode=True))
    rows = engine.results(images.image_files(spark, str(tmp_path)))
    got = {r.image: r.status for r in rows.collect()}
    assert got["0.png"] == "ERROR: no tensor" and got["cut.png"].startswith("ERROR: ") and {got[f"{k}.png"] for k in (1, 2, 3)} == {"FAILED"}
    dead = sinks.dead_letters(rows, str(tmp_path / "dead"))
    assert sorted(r.image for r in dead.collect()) == ["0.png", "cut.png"]
    again = Engine(spark, FunctionBackend(maker())).run([r.path for r in dead.collect()])
    assert {r.image: r.status.split(":")[0] for r in again.collect()} == {"0.png": "FAILED", "cut.png": "ERROR"}


def test_a_worker_that_cannot_start(spark, folder):
    def make():
        raise OSError("no model")

    rows = Engine(spark, FunctionBackend(make)).run(str(folder)).collect()
    assert {r.image: r.status for r in rows}["a.png"] == NOT_STARTED and len(rows) == 3
    with pytest.raises(Exception, match="no model"):
        Engine(spark, FunctionBackend(make, fail_fast=True)).run(str(folder)).collect()


def test_options_reach_the_recogniser(spark, folder):
    def make(options):
        return lambda image: [(f"batch {options.batch}", None, [[0, 0]] * 4)]

    seen = Engine(spark, FunctionBackend(make, options=ON_GPU)).see(images.image_files(spark, str(folder))).where("tokens IS NOT NULL").collect()
    assert [t.text for r in seen for t in r.tokens] == ["batch 16"]


def plan_nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from plan_nodes(plan.children().apply(k))


def test_only_recognition_has_the_resource_profile(spark, folder):
    backend = FunctionBackend(maker(), options=ON_CPU, profile=resource_profile(ON_CPU))
    seen = see_files(images.image_files(spark, str(folder)), backend)
    nodes = list(plan_nodes(seen.withColumn("n", F.size("tokens")).groupBy("n").count()._jdf.queryExecution().optimizedPlan()))
    with_profile = [n for n in nodes if n.nodeName() == "MapInPandas" and n.profile().isDefined()]
    assert len(with_profile) == 1 and sum(n.nodeName() == "MapInPandas" for n in nodes) == 1
    needs = resource_profile(ON_GPU, gpu_script="/opt/gpus.sh")
    assert needs.taskResources["gpu"].amount == pytest.approx(1 / 3) and needs.executorResources["gpu"].amount == 1 and resource_profile(ON_CPU).taskResources["cpus"].amount == 2
    assert "gpu" not in resource_profile(ON_CPU).taskResources


def test_no_pixels_in_any_exchange(spark, folder):
    seen = see_files(images.image_files(spark, str(folder)), FunctionBackend(maker()))
    plan = seen.groupBy("error").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "content" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    dtypes = dict(seen.dtypes)
    assert "binary" not in dtypes.values() and "data" not in dtypes


def test_judge_equals_the_gate_in_sql(spark):
    import itertools

    import pandas as pd

    from docweave.operators import quality

    sizes = [(199, 150), (200, 149), (200, 150), (1200, 900), (400, 300), (2000, 1500)]
    values = itertools.product(sizes, (0.0, 49.9, 75.0, 100.0, 4001.0), (7.9, 15.0, 40.0, 151.0), (0.079, 0.15, 0.5, 0.86), (3.9, 4.0, 10.0), (0.0009, 0.015), (0.0, 0.6), (34.9, 35.0, 70.0, 250.5, 255.0))
    rows = [dict(zip(("width", "height", "sharpness", "contrast", "eta", "char_height", "density", "reflection", "brightness"), (*a, *more), strict=True)) for a, *more in values]
    got = quality.combine(quality.scores(spark.createDataFrame(pd.DataFrame(rows)))).select("status", "sharpness_score", "contrast_score").collect()
    assert [tuple(r) for r in got] == [quality.judge(r) for r in rows]


def test_debug_dump(spark, tmp_path):
    x = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    df = spark.createDataFrame([("file:///x/a.png", 2, 3, x.tobytes()), ("/x/b.BMP", 2, 3, x.tobytes()), ("c", 2, 3, x.tobytes())], "path string, height int, width int, data binary")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/url"):
        names = sorted(r.file.rsplit("/", 1)[1] for r in sinks.dump_images(df, folder).collect())
        assert names == ["a_preprocessed.png", "b_preprocessed.BMP", "c_preprocessed.png"]
        for r in spark.read.format("image").load(folder).select("image.*").collect():
            assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(2, 3, 3), x)
    with pytest.raises(Exception, match="fs"):
        sinks.dump_images(df, "viewfs://store/x").collect()


def test_debug_folder_of_the_engine(spark, folder, tmp_path):
    config = EngineConfig(debug_dir=str(tmp_path))
    Engine(spark, FunctionBackend(maker(), config), config).run(str(folder))
    assert [p.name for p in tmp_path.iterdir()] == ["a_preprocessed.png"]  # only the accepted image


def test_png_writer():
    rng = np.random.default_rng(0)
    for x in (page(), rng.integers(0, 256, (33, 21, 3), dtype=np.uint8), np.zeros((1, 1, 3), np.uint8), np.add.outer(np.arange(40), np.arange(30))[..., None].repeat(3, 2).astype(np.uint8)):
        assert np.array_equal(decode.decode(encode.png(x)), x) and np.array_equal(decode.decode(encode.bmp(x)), x)


def test_csv_parts_are_one_file_in_order(spark, tmp_path):
    """Whatever the number of parts, together they have the bytes that one writer gives."""
    import csv
    import io
    import json

    rng = np.random.default_rng(2)
    odd = ["x;y", 'say "no"', "two\nlines", " pad ", "é", "", None, "-"]
    rows = [(f"i{int(rng.integers(0, 400)):03d}.png", ("SUCCESS", "FAILED", "ERROR: a;b")[k % 3], odd[k % 8], None if k % 2 else f"n{k}", "z") for k in range(500)]
    df = spark.createDataFrame(rows, "image string, status string, nom string, numero_document string, adresse string").repartition(7)
    names = ["image", "status", "numero_document", "nom", "adresse"]
    plain = [{"image": i, "status": s, "nom": n, "numero_document": d, "adresse": a} if s == "SUCCESS" else {"image": i, "status": s} for i, s, n, d, a in rows]
    plain.sort(key=lambda r: (r["status"] != "SUCCESS", r["image"], *[(r.get(c) is not None, r.get(c) or "") for c in names]))
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, names, delimiter=";")
    writer.writeheader()
    writer.writerows(plain)
    for per, least in ((1_000_000, 1), (60, 5)):
        folder = tmp_path / "out"
        assert sinks.write_csv(df, str(folder), per)
        listed = json.loads((folder / "_ORDER.json").read_text())
        assert len(listed) >= least and sum(p["rows"] for p in listed) == 500 and sorted(p.name for p in folder.glob("part-*.csv")) == [p["file"] for p in listed]
        assert b"".join((folder / p["file"]).read_bytes() for p in listed) == out.getvalue().encode("utf-8-sig")
        assert not list(folder.glob("_temporary*")) and (folder / "_SUCCESS").exists()


def test_a_failed_csv_leaves_the_old_one(spark, tmp_path):
    good = spark.createDataFrame([("a", "SUCCESS", "x")], "image string, status string, nom string")
    assert sinks.write_csv(good, str(tmp_path))
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")}
    spark.dataSource.register(sinks.OrderedCsv)
    bad = good.repartition(2).select("image", F.when(F.col("image") == "a", F.raise_error(F.lit("stop")).cast("string")).alias("status"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("ordered_csv").mode("overwrite").save(str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")} == before


def test_line_numbers(spark):
    rows = [(k * 7919 % 1000, None if k % 10 == 0 else k % 4, "same") for k in range(1000)] + [(5, 1, "same")] * 50
    got = sinks.number_lines(spark.createDataFrame(rows, "k int, g int, line string").repartition(9), F.col("g"), "k", name="at").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted(r["at"] for r in got) == list(range(1, 1051)) and [tuple(r)[:3] for r in sorted(got, key=lambda r: r["at"])] == want
    plan = sinks.number_lines(spark.createDataFrame(rows, "k int, g int, line string"), "k", name="at")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert sinks.number_lines(spark.createDataFrame([], "k int"), "k").count() == 0


def test_sqlite(spark, folder, tmp_path):
    db = folder / "list.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE images (path TEXT)")
        c.executemany("INSERT INTO images VALUES (?)", [(" a.png ",), ("a.png",), ("gone.png",), ("",), (None,), (str(folder / "broken.jpg"),), (".//sub/./B.PNG",)])
    want = [str(folder / "a.png")] * 2 + [str(folder / "broken.jpg"), str(folder / "sub" / "B.PNG")]
    url = f"sqlite:///{db}"
    assert [r.path for r in images.images_from_sqlite(spark, url).collect()] == want
    assert [r.path for r in images.images_from_sqlite(spark, url, "SELECT path, 1 FROM images ORDER BY path;").collect()] == want
    assert [r.path for r in images.images_from_sqlite(spark, str(db), listing=images.list_images(spark, str(folder))).collect()] == want
    for query in ("SELECT nothing FROM nowhere", "SELECT path FROM images WHERE 0", "no SQL"):
        with pytest.raises(ValueError):
            images.images_from_sqlite(spark, url, query)
    for table in ({"table": "nowhere"}, {"column": "nothing"}):
        with pytest.raises(ValueError):
            images.images_from_sqlite(spark, url, **table)
    for gone in ((url, "SELECT 'gone.png'"), ("sqlite:///" + str(tmp_path / "none.db"),), (str(tmp_path),)):
        with pytest.raises(FileNotFoundError):
            images.images_from_sqlite(spark, *gone)


def test_sqlite_plans_ranges_and_reads_each_row_once(spark, tmp_path):
    db = tmp_path / "many.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE images (path TEXT)")
        c.executemany("INSERT INTO images (rowid, path) VALUES (?, ?)", [(k * 3 - 50, f"p{k}") for k in range(1000)])
        c.execute("CREATE TABLE keyed (path TEXT PRIMARY KEY) WITHOUT ROWID")
        c.executemany("INSERT INTO keyed VALUES (?)", [(f"p{k}",) for k in range(1000)])
    for asked in ({}, {"table": "keyed"}, {"query": "SELECT path FROM images WHERE path <> ''"}, {"query": "SELECT path, path FROM keyed"}):
        df = sqlite.read_sqlite(spark, [str(db)], rows=100, **asked)
        assert df.rdd.getNumPartitions() >= 10
        assert sorted(r.value for r in df.collect()) == sorted(f"p{k}" for k in range(1000))
    assert len(sqlite.plan(str(db), "PRAGMA table_info(images)", "", "")) == 1
    assert sqlite.plan(str(db), None, "images", "path", 1)[-1].bounds[1] == 999 * 3 - 50 + 1 and len(sqlite.plan(str(db), None, "images", "path", 1)) <= sqlite.MOST_RANGES


def test_stream_equals_batch(spark, folder, tmp_path):
    from docweave.plans import engine, synth
    from docweave.streaming import incoming

    tokens = synth.identity_tokens(spark, "/root/testdata/sf0.001").where("doc_id < 30")
    tokens.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = incoming.run_stream(incoming.incoming_tokens(spark, str(tmp_path / "in"), TOKENS), engine.extract_documents, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, engine.extract_documents(tokens).collect()))
    names = incoming.run_stream(incoming.incoming_files(spark, str(folder)), lambda b: b.select("path"), str(tmp_path / "files"), str(tmp_path / "check2"))
    names.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "files")).count() == 3


def test_processing_stops_keeps_what_is_done_and_goes_on(spark, tmp_path):
    """A recogniser that never ends on some images is interrupted; finished slices stay, no half one is left, and the rest follows."""
    from docweave.streaming.processing import Processing

    scans, out, flag = tmp_path / "scans", tmp_path / "out", tmp_path / "go"
    scans.mkdir()
    for k in range(5):
        x = page()
        x[:4, :4] = k * 50
        (scans / f"{k}.png").write_bytes(png(x))
        os.utime(scans / f"{k}.png", (1_000_000 + k, 1_000_000 + k))

    def make():
        def read(image):
            while image[1, 1, 0] > 80 and not os.path.exists(flag):
                time.sleep(0.1)
            return [("Nom", 0.9, [[0, 0], [60, 0], [60, 20], [0, 20]])]

        return read

    config = EngineConfig(fast_mode=True)
    engine = Engine(spark, FunctionBackend(make, config), config)
    first = Processing(engine, str(scans), str(out), files=1)
    first.on_slice = lambda p: threading.Timer(6.0, lambda: first.stop(now=True)).start() if p.slices == 2 else None
    done = first.start().wait(240)
    assert (done.state, done.slices, done.images, done.error) == ("stopped", 2, 2, None)
    names = lambda: sorted(p.name for p in out.iterdir() if not p.name.startswith("."))
    assert names() == ["_checkpoint", "slice=0", "slice=1"]
    assert sorted(r.image for r in first.results().collect()) == ["0.png", "1.png"]
    flag.touch()
    last = Processing(engine, str(scans), str(out), files=1).start()
    assert last.wait(240).state == "done" and last.progress.images == 3
    assert sorted(r.image for r in last.results().collect()) == [f"{k}.png" for k in range(5)] and names() == ["_checkpoint", *[f"slice={k}" for k in range(5)]]
    assert not engine.held
    for _ in range(100):  # the listener's reports come from another thread
        if last.progress.files >= 3:
            break
        time.sleep(0.1)
    assert last.progress.files == 3 and last.progress.seconds > 0


def test_tags_interrupt_their_own_jobs_only(spark):
    from docweave.streaming.processing import interrupt, tagged

    said = {}

    def work(tag, seconds):
        def slow(batches):
            for b in batches:
                time.sleep(seconds)
                yield b

        with tagged(spark, tag):
            try:
                said[tag] = spark.range(1).mapInPandas(slow, "id long").count()
            except Exception as e:  # noqa: BLE001
                said[tag] = type(e).__name__

    threads = [InheritableThread(target=work, args=a) for a in (("a", 60), ("b", 4))]
    for t in threads:
        t.start()
    time.sleep(2)
    interrupt(spark, "a")
    for t in threads:
        t.join(50)
    assert said["b"] == 1 and isinstance(said["a"], str)


def test_validators_and_dates(spark):
    from pyspark.sql import functions as F

    from docweave.functions import text as t

    cases = [("sexe", " m ", True), ("numero_document", "ab12345", False), ("nationalite", "Nationalité X", False), ("adresse", "12, rue É.", True), ("date_naissance", "1 NOV/NOV 1990", True), ("nom", "dupont", False), ("other", "?", True), ("date_naissance", "١٢٣٤٥٦٧٨", True), ("nom", "محمد", True), ("prenom", "Anne, Marie", True), ("nom", "Anne, Marie", False)]
    df = spark.createDataFrame(cases, "f string, v string, ok boolean").withColumn("got", t.is_valid(F.col("f"), F.col("v")))
    assert all(r.ok == r.got for r in df.collect())
    dates = [("05 NOV/NOV 2023", "05/11/2023"), ("12.31.1999", "12/31/1999"), ("1/2/1990", "1/2/1990"), ("5nov1990", "05/11/1990"), ("05 XXX 1990", "05 XXX 1990")]
    assert all(r.want == r.got for r in spark.createDataFrame(dates, "v string, want string").withColumn("got", t.free_date(F.col("v"))).collect())


def test_outlines_are_filled_and_hold_no_other():
    m = np.zeros((12, 12), bool)
    m[1:9, 1:9] = True
    m[3:7, 3:7] = False
    m[5, 5] = m[10, 10] = True
    found, area = kernels.outer_parts(m)
    assert found[:, :4].tolist() == [[1, 1, 8, 8], [10, 10, 1, 1]] and area.tolist() == [49.0, 0.0]
    assert [len(a) for a in kernels.outer_parts(np.zeros((5, 6), bool))] == [0, 0]


@pytest.mark.parametrize("angle", [1.0, -7.0, 12.0])
def test_skew_is_the_median_of_segments(angle):
    turned = kernels.rotate(page(), angle)
    found = kernels.level_segments(kernels.canny(kernels.gray(turned), 50, 150))
    assert len(found) > 5 and (found[:, 2] - found[:, 0] >= turned.shape[1] // 6).all()
    assert abs(kernels.skew_angle(kernels.gray(turned)) + angle) < 0.3
    assert kernels.level_segments(np.zeros((40, 30), bool)).shape == (0, 4)


def test_regions_broadcast_nothing(spark):
    """Broadcasts of all rounds went through the driver."""
    from docweave.operators import regions

    tiles = spark.createDataFrame([(1, 0, 0, 2, 2, bytearray(b"\x01\x01\x00\x01")), (1, 0, 2, 2, 2, bytearray(b"\x00\x00\x01\x00"))], "id long, y0 int, x0 int, height int, width int, mask binary")
    found = regions.regions(tiles)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, 3, 2, 4)]
    links = regions.touching(regions.tile_parts(tiles))
    assert all("Broadcast" not in x._jdf.queryExecution().executedPlan().toString() for x in (found, links))
