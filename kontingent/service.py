"""Requests as dictionaries: what a web server, a command line or a JSON-RPC loop calls."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import asdict

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import SparkSession

from . import algebra
from .errors import KontingentError, SearchCancelled, ValidationError
from .operators import binning
from .operators import fit as fitting
from .operators import table as tables
from .operators.analyzer import Analyzer, dense_entropy
from .plans import search as searching
from .progress import Event, tagged
from .sources import formats

# Defaults of a search request.
DEFAULTS = {"direction": "up", "filter": "loopless", "width": 3, "levels": 7, "sortBy": "bic"}

# Names of binning strategies in requests.
STRATEGY_NAMES = {"none": "none", "width": "equalWidth", "quantile": "equalFrequency", "breaks": "customBreaks", "top": "topN", "threshold": "frequencyThreshold"}


class RunningSearch:
    """A search on a thread of its own.  Its jobs carry its tag; ``cancel`` interrupts them, and no other search's."""

    def __init__(self, service: "Service", request_id: str, payload: dict, send):
        self.id, self.tag = request_id, f"kontingent-search-{uuid.uuid4().hex}"
        self._service, self._payload, self._send = service, payload, send
        self._stop = threading.Event()
        self.thread = InheritableThread(target=self._run)
        self.thread.start()

    @property
    def is_running(self) -> bool:
        return self.thread.is_alive()

    def cancel(self) -> None:
        self._stop.set()
        self._service.spark.sparkContext.cancelJobsWithTag(self.tag)

    def join(self, seconds: float | None = None) -> None:
        self.thread.join(seconds)

    def _say(self, kind: str, payload: dict) -> None:
        self._send({"type": kind, "requestId": self.id, "payload": payload})

    def _tell(self, event: Event) -> None:
        if self._stop.is_set():
            raise SearchCancelled("the search was cancelled")
        self._say("progress", {"kind": event.kind} | event.data)

    def _run(self) -> None:
        try:
            result = self._service.search(self._payload, self._tell, self.tag)
            if self._stop.is_set():
                raise SearchCancelled("the search was cancelled")
            self._say("result", result)
        except Exception as e:  # whatever ends a search is told to whoever waits for it
            if self._stop.is_set():
                self._say("cancelled", {})
            else:
                self._say("error", {"message": str(e)})
        finally:
            self._service.running.pop(self.id, None)


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.running: dict[str, RunningSearch] = {}

    def _data(self, request: dict) -> formats.DataSet:
        data = request.get("data")
        if data is None:
            raise ValidationError("the request has no data")
        return formats.read_json(self.spark, data if isinstance(data, str) else json.dumps(data))

    def _analyzer(self, request: dict) -> Analyzer:
        data = self._data(request)
        return Analyzer(data.table(), data.schema)

    def health(self, request: dict | None = None) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def data_info(self, request: dict) -> dict:
        data = self._data(request)
        return {"name": data.name, "variables": formats.variables_json(data.schema), "sampleSize": data.sample_size(), "stateSpace": data.schema.cells(), "isDirected": data.schema.is_directed}

    def fit_model(self, request: dict) -> dict:
        a = self._analyzer(request)
        m = algebra.parse_model(a.schema, request["model"])
        out = asdict(a.fit(m))
        if request.get("residuals"):
            rows = a.residuals(m).orderBy(*a.schema.columns)
            out["residuals"] = [r.asDict() for r in (rows.limit(int(request["limit"])) if "limit" in request else rows).collect()]
        return out

    def search(self, request: dict, progress=None, tag: str | None = None) -> dict:
        """Honours the direction, reference model and sort of the request; filter may also be full, disjoint or chain.

        ``profile`` in the request adds a profile by level.
        """
        r = DEFAULTS | request
        with tagged(self.spark, *([tag] if tag else [])):
            a = self._analyzer(r)
            args = a, r["filter"], r["direction"], r["sortBy"], int(r["width"]), int(r["levels"]), r.get("referenceModel") or None
            profile = None
            if r.get("profile"):
                found, profile = searching.profiled(*args, progress=progress, tag=tag)
            else:
                found = searching.search(*args, progress, tag)
            rows = [{"rank": k + 1, "level": c.level} | a.evaluate([c.model])[0] for k, c in enumerate(found.candidates)]
            a.release()
        return {"results": rows, "levels": [asdict(x) for x in found.levels], "seconds": found.seconds} | ({"profile": profile.to_dict()} if profile else {})

    def estimate(self, request: dict) -> dict:
        r = DEFAULTS | request
        data = self._data(r)
        return searching.estimate(data.schema, r["filter"], r["sortBy"], int(r["width"]), int(r["levels"]), data.rows.count(), r["direction"],
                                  self.spark.sparkContext.defaultParallelism)

    # Compact forms: small tables in, small tables out ------------------------------------

    def fit_compact(self, text: str) -> dict:
        """A model fitted by proportional fitting to cells {"variables", "data": [{"key", "count"}], "model"}; counts keep their sum."""

        def run():
            cells, schema, name = formats.read_cells(self.spark, text)
            a, m = Analyzer(cells, schema), algebra.parse_model(schema, name or "")
            q, info = fitting.dense_ipf(a.dense() * a.n, m.relations)
            keys = [c for c in np.argwhere(q > 0).tolist()]
            data = [{"key": k, "count": float(q[tuple(k)])} for k in keys]
            return {"data": data, "entropy": dense_entropy(q / q.sum()), "iterations": info.iterations, "converged": info.converged, "model": m.name}

        return self._told(run)

    def entropy_compact(self, text: str) -> dict:
        """The entropy of cells, in bits."""
        return self._told(lambda: {"entropy": tables.entropy(formats.read_cells(self.spark, text)[0])})

    def _columns(self, request: dict):
        names = list(map(str, request["columns"]))
        rows = [[str(x) for x in r[: len(names)]] + [""] * (len(names) - len(r)) for r in request["data"]]
        return names, self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))

    def analyze_columns(self, request: dict, threshold: int = 10) -> dict:
        """A profile of each column of {"columns", "data"}, its most frequent values, and how it might be binned."""

        def run():
            names, df = self._columns(request)
            out = []
            for k, r in enumerate(sorted(binning.analyze(df).collect(), key=lambda r: names.index(r["column"]))):
                spec = binning.suggest(r["is_numeric"], r["unique_count"]) if r["unique_count"] > threshold else binning.BinSpec("none")
                top = [{"value": t["value"], "count": t["n"]} for t in binning.frequencies(df, r["column"]).limit(10).collect()]
                out.append({"name": r["column"], "index": k, "isNumeric": r["is_numeric"], "uniqueCount": r["unique_count"], "totalCount": r["n_rows"], "missingCount": r["missing_count"],
                            "minVal": r["min"] if r["is_numeric"] else None, "maxVal": r["max"] if r["is_numeric"] else None, "needsBinning": r["unique_count"] > threshold,
                            "suggestedStrategy": STRATEGY_NAMES[spec.strategy], "topValues": top})
            return {"columns": out}

        return self._told(run)

    def suggest_bins(self, request: dict, threshold: int = 10) -> dict:
        """A configuration for each profiled column."""

        def one(c: dict) -> dict:
            common = {"otherLabel": "Other", "missingHandling": "separateBin", "missingLabel": "Missing"}
            spec = binning.suggest(c["isNumeric"], c["uniqueCount"]) if c["uniqueCount"] > threshold else binning.BinSpec("none", bins=c["uniqueCount"])
            size = {"topN": spec.top} if spec.strategy == "top" else {"numBins": spec.bins}
            style = {} if spec.strategy == "none" else {"labelStyle": "range" if spec.strategy == "width" else "index"}
            return {"strategy": STRATEGY_NAMES[spec.strategy]} | size | style | common

        return self._told(lambda: {"configs": {c["name"]: one(c) for c in request["columns"]}})

    def apply_bins(self, request: dict, configs: dict) -> dict:
        """Columns binned as configured (range labels with one decimal), equal rows merged: variables, codes and counts."""

        def run():
            names, df = self._columns(request)
            specs = {}
            for n in names:
                c = configs["configs"].get(n, {})
                strategy = next((k for k, v in STRATEGY_NAMES.items() if v == c.get("strategy", "none")), "none")
                missing = "separate" if c.get("missingHandling", "separateBin") == "separateBin" else "exclude"
                specs[n] = binning.BinSpec(strategy, bins=int(c.get("numBins", 5)), top=int(c.get("topN", 5)), labels=c.get("labelStyle", "range") if strategy == "width" else "index",
                                           precision=1, missing=missing, missing_label=c.get("missingLabel", "Missing"), other_label=c.get("otherLabel", "Other"))
            binned, fitted = binning.apply_binning(df, specs)
            schema = binning.schema_of(fitted)
            place = {v.name: {label: k for k, label in enumerate(v.values)} for v in schema}
            rows = sorted(([place[n][r[n]] for n in names], r["value"]) for r in binned.collect())
            return {"variables": formats.variables_json(schema), "data": [k for k, _ in rows], "counts": [n for _, n in rows]}

        return self._told(run)

    @staticmethod
    def _told(run) -> dict:
        """What ``run`` returns with success, or its error as a message."""
        try:
            return run() | {"success": True}
        except (KontingentError, KeyError, ValueError, TypeError) as e:
            return {"success": False, "error": str(e)}

    def stream(self, message: dict, send) -> RunningSearch | None:
        """One message of a search conversation; events, and a result, error or cancellation, go to ``send`` from the search's thread.

        A search goes by its message's ``requestId``; ``search_cancel`` with that id ends it and no other.  Returns the search
        that was started or cancelled.
        """
        request_id = str(message.get("requestId", ""))
        kind = message.get("type")
        fail = lambda text: send({"type": "error", "requestId": request_id, "payload": {"message": text}})
        if kind == "search_start":
            if request_id in self.running:
                return fail(f"a search {request_id!r} is running")
            self.running[request_id] = search = RunningSearch(self, request_id, message.get("payload", {}), send)
            if not search.is_running:  # it may have ended before it was listed
                self.running.pop(request_id, None)
            return search
        if kind == "search_cancel":
            search = self.running.get(request_id)
            if search is None:
                return fail(f"no search {request_id!r} is running")
            search.cancel()
            return search
        return fail(f"unknown message {kind!r}")


class JsonRpc:
    """JSON-RPC 2.0 with tools/list and tools/call over one data set that stays loaded."""

    TOOLS = {"load_data": "Load a data set from JSON", "info": "Describe the data set", "fit": "Fit a model", "search": "Search models"}

    def __init__(self, service: Service):
        self.service, self.data = service, None

    def handle(self, line: str) -> str | None:
        try:
            request = json.loads(line)
        except ValueError:
            return self._reply(None, error=(-32700, "parse error"))
        if not isinstance(request, dict) or "method" not in request:
            return self._reply(None, error=(-32600, "invalid request"))
        if "id" not in request:
            return None  # a notification
        try:
            return self._reply(request["id"], self._call(request["method"], request.get("params") or {}))
        except LookupError as e:
            return self._reply(request["id"], error=(-32601, f"method not found: {e}"))
        except (KontingentError, ValueError) as e:
            return self._reply(request["id"], error=(-32602, str(e)))

    def _call(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "kontingent", "version": "0.1"}}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object"}} for n, d in self.TOOLS.items()]}
        if method != "tools/call" or params.get("name") not in self.TOOLS:
            raise LookupError(params.get("name") or method)
        name, args = params["name"], dict(params.get("arguments") or {})
        if name == "load_data":
            self.data = args.get("data")
        if self.data is None:
            raise ValidationError("no data set is loaded")
        args["data"] = self.data
        run = {"load_data": self.service.data_info, "info": self.service.data_info, "fit": self.service.fit_model, "search": self.service.search}[name]
        return {"content": [{"type": "text", "text": json.dumps(run(args), default=str)}]}

    @staticmethod
    def _reply(id_, result=None, error=None) -> str:
        body = {"jsonrpc": "2.0", "id": id_}
        return json.dumps(body | ({"error": {"code": error[0], "message": error[1]}} if error else {"result": result}))


def event_json(event: Event) -> str:
    return event.to_json()
