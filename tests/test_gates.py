"""Image gate, signatures, catalogue, capacity."""

import json
import math
import random

from pyspark.sql import functions as F

from sluiceway.operators import catalogue, imagegate
from sluiceway.sources import readers

FIELDS = dict.fromkeys(imagegate.VERDICT_FIELDS, False)


def test_verdict_documents_fail_closed(spark):
    good = json.dumps(FIELDS)
    bad = ["", None, "[]", "null", good + " junk", good[:-1], "[" + good + "]", good + good, json.dumps({**FIELDS, "nsfw": "true"}),
           json.dumps({**FIELDS, "nsfw": 1}), json.dumps({**FIELDS, "nsfw": None}), json.dumps({k: v for k, v in FIELDS.items() if k != "illegal"})]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad])], "i int, raw string")
    read = [r.v for r in rows.select("i", imagegate.parse_verdict(F.col("raw")).alias("v")).orderBy("i").collect()]
    assert read[0] is not None and read[1:] == [None] * len(bad)


def test_image_decisions(spark):
    cases = [({}, False, "keep", None), ({"nsfw": True}, False, "destroy_nsfw", "S12"), ({"nsfw": True}, True, "keep", None), ({"violence_gore": True}, False, "destroy_nsfw", "S12"),
             ({"illegal": True}, True, "destroy_illegal", "S3"), ({"minor_present": True}, False, "keep", None), ({"minor_present": True, "nsfw": True}, True, "destroy_illegal", "S4"),
             ({"sexual_minor": True}, True, "destroy_illegal", "S4")]
    rows = spark.createDataFrame([(i, json.dumps({**FIELDS, **c[0]}), c[1]) for i, c in enumerate(cases)] + [(99, "junk", True)], "i int, raw string, g boolean")
    got = [(r.d.action, r.d.code) for r in rows.select("i", imagegate.decide(imagegate.parse_verdict(F.col("raw")), F.col("g")).alias("d")).orderBy("i").collect()]
    assert got == [(c[2], c[3]) for c in cases] + [("destroy_unparseable", "UNPARSEABLE_VERDICT")]


def test_output_gate(spark):
    outputs = spark.createDataFrame([(1, "/s/out/a.png", False), (2, "/s/out/b.png", False), (3, "/s/out/../x.png", False)], "id int, path string, nsfw_grant boolean")
    verdicts = spark.createDataFrame([(1, json.dumps(FIELDS)), (3, json.dumps(FIELDS))], "id int, raw string")
    judged = imagegate.output_gate(outputs, verdicts, ["id"], "/s/out")
    assert sorted((r.id, r.action) for r in judged.collect()) == [(1, "keep"), (2, "destroy_unparseable"), (3, "destroy_unparseable")]
    several = [(1, json.dumps(FIELDS)), (1, json.dumps(FIELDS | {"illegal": True})), (1, "?"), (2, json.dumps(FIELDS)), (2, "?")]
    judged = imagegate.output_gate(outputs, spark.createDataFrame(several, "id int, raw string"), ["id"])
    assert sorted((r.id, r.action) for r in judged.collect()) == [(1, "destroy_illegal"), (2, "destroy_unparseable"), (3, "destroy_unparseable")]
    assert ("UNPARSEABLE_VERDICT — unparseable", False) in [(r.detail, r.immutable) for r in imagegate.gate_audit(judged).collect()]


def test_workflow_inputs_and_file_gate(spark):
    workflow = {"1": {"class_type": "Loader", "inputs": {"ckpt": "sub\\m.safetensors", "n": 3, "link": ["2", 0]}}, "2": {"class_type": "Text", "inputs": {"text": "a cat", "blank": " "}}}
    inputs = imagegate.string_inputs(spark.createDataFrame([("w", json.dumps(workflow))], "workflow_id string, workflow_json string"))
    inventory = spark.createDataFrame([("m.safetensors",)], "name string")
    assert [r.name for r in imagegate.file_refs(inputs, inventory).collect()] == ["m.safetensors"]
    assert [r.value for r in imagegate.text_inputs(inputs, inventory).collect()] == ["a cat"]
    owners = spark.createDataFrame([("w", False, False), ("x", False, True), ("y", True, False), ("z", False, False)], "wf string, nsfw_grant boolean, admin boolean")
    refs = spark.createDataFrame([("w", 1, "b"), ("w", 0, "a"), ("x", 0, "c"), ("y", 0, "a")], "wf string, pos int, name string")
    registry = spark.createDataFrame([("a", "yes"), ("b", "no")], "name string, nsfw string")
    got = {r.wf: (r.allowed, r.reason) for r in imagegate.file_gate(owners, refs, registry, "wf", "name", "pos").collect()}
    assert got == {"w": (False, "a is marked NSFW and your account does not have the NSFW grant"), "x": (True, None), "y": (True, None), "z": (True, None)}


def test_image_signature_is_the_cosine_transform(spark):
    rng = random.Random(1)
    pixels = [float(rng.randint(0, 255)) for _ in range(1024)]
    wave = [[math.cos((2 * x + 1) * u * math.pi / 64) for x in range(32)] for u in range(8)]
    block = [sum(pixels[y * 32 + x] * wave[u][x] * wave[v][y] for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
    median = sorted(block[1:])[31]
    expected = f"{int(''.join('1' if b > median else '0' for b in block), 2):016x}"
    rows = spark.createDataFrame([(pixels,), ([1.0],), (None,)], "p array<double>")
    assert [r.s for r in rows.select(imagegate.image_signature(F.col("p")).alias("s")).collect()] == [expected, None, None]


def test_signature_matches_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(15)] + [0, 0, (1 << 64) - 1]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)]
    frame = lambda values: spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id int, signature string")
    got = {r.id: (r.matches, r.nearest, r.distance) for r in imagegate.signature_matches(frame(near), frame(base).withColumnRenamed("id", "held"), "id", "held").collect()}
    expected = {}
    for i, v in enumerate(near):
        close = [((v ^ b).bit_count(), j) for j, b in enumerate(base) if (v ^ b).bit_count() <= 3]
        if close:
            expected[i] = (len(close), min(close)[1], min(close)[0])
    assert got == expected


def test_catalogue(spark, tmp_path):
    hub = [{"id": "a/m", "tags": ["gguf"], "downloads": 5, "gated": "auto", "createdAt": "2024-01-02T00:00:00"}, {"id": "solo", "tags": ["not-for-all-audiences"], "pipeline_tag": "x"}]
    image = lambda level, url="u": {"url": url, "nsfwLevel": level}
    versions = [{"files": [{"name": "a", "sizeKB": 1.0}, {"name": "b", "sizeKB": 2.0, "primary": True}], "images": [image(4), image(1, "https://h/width=9/x")]}, {"earlyAccessEndsAt": "2030", "images": [image(1)] * 8}]
    gallery = {"items": [{"id": 7, "name": "n", "nsfw": False, "modelVersions": versions, "stats": {"downloadCount": 3}}, {"id": 8, "nsfw": True}]}
    (tmp_path / "hub.json").write_text(json.dumps(hub))
    (tmp_path / "gal.json").write_text(json.dumps(gallery))
    raw = {"hf": readers.read_listing(spark, str(tmp_path / "hub.json")), "civitai": readers.read_listing(spark, str(tmp_path / "gal.json"), "items")}
    got = {r.id: r for r in catalogue.items(raw).collect()}
    assert set(got) == {"a/m", "7"} and set(r.id for r in catalogue.items(raw, adult=True).collect()) == {"a/m", "solo", "7", "8"}
    assert (got["a/m"].name, got["a/m"].author, got["a/m"].type, got["a/m"].gated, got["a/m"].updated) == ("m", "a", "gguf", True, "2024-01-02")
    assert (got["7"].size, got["7"].buzz, got["7"].thumb, got["7"].downloads) == (2048.0, True, "https://h/width=450,anim=false/x", 3)
    shown = catalogue.version_previews(raw["civitai"]).where("id = '7'")
    assert shown.count() == 7
    assert [r.id for r in catalogue.top(catalogue.items(raw), "downloads", 1).collect()] == ["a/m"]


def test_inventory(spark, tmp_path):
    for path in ("checkpoints/a/m.safetensors", "loras/m.safetensors", "loras/x.part", "input/y.pt", "vae/Z.PT"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"123")
    inventory = readers.read_inventory(spark, str(tmp_path))
    assert sorted((r.name, r.path, r.size) for r in inventory.collect()) == [("Z.PT", "vae/Z.PT", 3), ("m.safetensors", "loras/m.safetensors", 3)]
    registry = spark.createDataFrame([("Z.PT", "no")], "name string, nsfw string")
    assert [(r.name, r.nsfw) for r in readers.store_listing(inventory, registry).collect()] == [("m.safetensors", "unclassified"), ("Z.PT", "no")]


def test_models(spark):
    installed = spark.createDataFrame([("a:latest",), ("llama-guard3:1b",)], "name string")
    resident = spark.createDataFrame([("a:latest", 5, "p")], "name string, size_vram long, pool string")
    assert sorted((r.name, r.loaded, r.vram, r.is_guard) for r in catalogue.installed_models(installed, resident).collect()) == [("a:latest", True, 5, False), ("llama-guard3:1b", False, 0, True)]
    exposed = spark.createDataFrame([("z", "ollama_chat/a"), ("b", "ollama/q"), ("c", "other/a")], "name string, model string")
    assert [(r.name, r.resident) for r in catalogue.exposed_models(exposed, resident).collect()] == [("z", True), ("b", False)]


def test_filed_signatures_are_not_broadcast(spark):
    """Few signatures make many filed rows: the driver must not collect them, at planning or when stages have run."""
    rows = spark.range(2000).select("id", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("signature"))
    joined = imagegate.signature_matches(rows, rows.withColumnRenamed("id", "held"), "id", "held")
    assert joined.count() == 2000
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not any("Generate" in part.split("BroadcastHashJoin")[0].split("SortMergeJoin")[0] for part in plan.split("BroadcastExchange")[1:])
    assert "SortMergeJoin [combo" in plan
