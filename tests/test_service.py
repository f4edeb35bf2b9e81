import json
import sys
import threading
import types
import urllib.error
import urllib.request

import pytest

from causeway import api
from causeway.__main__ import main
from causeway.app import create_app
from causeway.plans import experiments as X
from causeway.plans.district import POINTS, build_district


def test_service(spark, tmp_path):
    server = api.serve(spark, 0, str(tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def post(path, body):
        return json.load(urllib.request.urlopen(urllib.request.Request(f"{at}{path}", body if isinstance(body, bytes) else json.dumps(body).encode(), method="POST")))

    assert post("/api/loss", {"failed": ["S0", "S1"]})["set_loss"] == pytest.approx(368)
    assert len(json.load(urllib.request.urlopen(f"{at}/api/evidence"))["register"]) == 21
    for path, body, status in (("/api/loss", {"failed": ["S99"]}, 400), ("/api/loss", b"[1]", 400), ("/api/loss", b"{", 400), ("/nothing", {}, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(path, body)
        assert e.value.code == status
    server.shutdown()


def test_app_of_the_library(spark, monkeypatch):
    with pytest.raises(ImportError, match="api.serve"):
        create_app(spark)
    routes = {}

    class HTTPException(Exception):
        def __init__(self, status_code, detail):
            self.status_code, self.detail = status_code, detail

    class FastAPI:
        def __init__(self, **_):
            pass

        def _add(self, path, **_):
            return lambda f: routes.setdefault(path, f)

        get = post = _add

    module, responses = types.ModuleType("fastapi"), types.ModuleType("fastapi.responses")
    module.FastAPI, module.HTTPException, responses.HTMLResponse = FastAPI, HTTPException, str
    monkeypatch.setitem(sys.modules, "fastapi", module)
    monkeypatch.setitem(sys.modules, "fastapi.responses", responses)
    create_app(spark)
    assert "/api/run" in routes["/"]() and routes["/api/loss"]({"failed": ["S0", "S1"]})["set_loss"] == pytest.approx(368) and len(routes["/api/evidence"]()["register"]) == 21
    with pytest.raises(HTTPException) as e:
        routes["/api/loss"]({"failed": ["S99"]})
    assert e.value.status_code == 400 and "S99" in e.value.detail
    assert routes["/api/loss"]({"redundancy": 4, "failed": [f"S{i}" for i in range(12)] + ["S0", "S1"]})["set_loss"] > 0


def test_district_of_layers(spark, tmp_path, capsys):
    keys = "".join(f'<key id="d{i}" for="x" attr.name="{n}"/>' for i, n in enumerate(("x", "y", "length", "highway", "bridge")))
    node = lambda i, x, y: f'<node id="{i}"><data key="d0">{x}</data><data key="d1">{y}</data></node>'
    edge = lambda u, v, more="": f'<edge source="{u}" target="{v}"><data key="d2">1000</data><data key="d3">primary</data>{more}</edge>'
    (tmp_path / "roads.graphml").write_text(f"<graphml>{keys}<graph>{node(1, 0, 0)}{node(2, 1, 0)}{node(3, 1, 1)}{node(4, 5, 5)}{edge(1, 2)}{edge(2, 3, '<data key=\"d4\">yes</data>')}</graph></graphml>")
    main(["district", str(tmp_path / "roads.graphml"), "--layers", str(tmp_path), "--out", str(tmp_path / "out")])
    assert "no water layer" in (tmp_path / "out/real_district_qa.md").read_text() and spark.read.parquet(str(tmp_path / "out/structures.parquet")).count() == 1
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    spark.createDataFrame([(1, at((0.5, -1), (0.5, 1)))], f"water_id long, {POINTS}").write.parquet(str(tmp_path / "water.parquet"))
    spark.createDataFrame([("v", "village", "1,200", at((0, 0)))], f"name string, place string, population string, {POINTS}").write.parquet(str(tmp_path / "places.parquet"))
    spark.createDataFrame([("hospital", "h", at((1, 1)))], f"amenity string, name string, {POINTS}").write.parquet(str(tmp_path / "facilities.parquet"))
    r = build_district(spark, str(tmp_path / "roads.graphml"), str(tmp_path), str(tmp_path / "out"))
    assert r["structures"] == {"tag": 1, "crossing": 1} and (r["nodes"], r["components"], r["habitations"], r["facilities"]) == (4, 2, 1, {"health": 1, "school": 0})
    text = (tmp_path / "out/real_district_qa.md").read_text()
    assert "inferred crossings: 1" in text and "can't be computed" not in text
    (tmp_path / "water.parquet" / "part-broken.parquet").write_bytes(b"none")
    with pytest.raises(Exception):  # noqa: B017  (a damaged layer isn't an absent one)
        build_district(spark, str(tmp_path / "roads.graphml"), str(tmp_path), str(tmp_path / "out"))


def test_commands(spark, tmp_path, capsys):
    main(["register"])
    assert capsys.readouterr().out.count("\n") == 23
    (tmp_path / "c.json").write_text(json.dumps({"redundancies": [1], "scenarios": 4, "years": 1}))
    main(["network_effects", "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "out")])
    assert "| 1 |" in (tmp_path / "out/results.md").read_text() and json.loads((tmp_path / "out/results.json").read_text())["by_redundancy"][0]["n_assets"] == 3


def test_published_robustness(spark):
    out = X.robustness(spark)
    r = out["robustness"]
    assert r["benefit_cost"]["win_rate"] == 0.875 and r["network_aware"]["win_rate"] == 0.125
    assert r["do_nothing"]["mean_regret"] == pytest.approx(17627.11, abs=0.01) and r["network_aware"]["max_regret"] == pytest.approx(3229.85, abs=0.01)
    assert out["per_draw"]["do_nothing"][0] == pytest.approx(180398.38497, abs=1e-4)
    assert "| benefit_cost | 0.88 |" in X.report(out)
