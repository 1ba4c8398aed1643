"""Go symbols, model replies, routing and titles in small cases."""

from __future__ import annotations


from corpusloom.operators import archive, code, extraction
from corpusloom.sources.tables import materialize

SERVICE = """// Package pay: func NotHere() {}
package pay

import "fmt"

import (
	// "commented/out"
	log "app/log"
	_ `raw/path`
)

/* type Hidden struct {
func Hidden() { hidden() }
*/

// PaymentService handles payments.
type PaymentService struct {
	limit func(int) int
}

type (
	Amount int
	HTTPClient interface {
		Do(x int) error
	}
	Pair[K any] struct{ k K }
)

var table = map[string]int{"a(": build(1)}

func NewPaymentService() *PaymentService { return &PaymentService{} }

func (s *PaymentService) Charge(amount int) {
	fmt.Println("call(me)", 'x', `raw(
	text(`)
	if (amount > 0) { validate(amount); validate(amount) }
	s.limit(3).then(4)
	a.b.c(5)
	go func() { inner(6) }()
}

const top = 1

func (p Pair[K]) Get(
	other K,
) K {
	return convert(other)
}

func validate(n int) bool { return n > 0 }
"""


def test_go_symbols(spark):  # noqa: ANN001
    files = spark.createDataFrame([("internal/pay/service.go", SERVICE), ("web/app.ts", "func X() {}"), ("no/clause.go", "func Y() {}"), ("empty.go", ""), ("null.go", None)], "path string, content string")
    e, r = code.extract_go_symbols(files)
    got = {(x["name"], x["type"]): x["aliases"] for x in e.collect()}
    assert got == {
        ("pay.PaymentService", "type"): ["PaymentService", "payment service"], ("pay.Amount", "type"): ["Amount"], ("pay.HTTPClient", "type"): ["HTTPClient"], ("pay.Pair", "type"): ["Pair"],
        ("pay.NewPaymentService", "function"): ["NewPaymentService", "new payment service"], ("pay.Charge", "function"): ["Charge", "(*PaymentService).Charge"], ("pay.Get", "function"): ["Get", "(Pair).Get"], ("pay.validate", "function"): ["validate"],
    }
    edges = {(x["src"], x["label"], x["dst"]) for x in r.collect()}
    path = "internal/pay/service.go"
    assert {x for x in edges if x[1] == "包含"} == {(path, "包含", name) for name, _ in got}
    assert {x[2] for x in edges if x[1] == "依赖"} == {"fmt", "app/log", "raw/path"}
    assert {x[::2] for x in edges if x[1] == "调用"} == {("pay.Charge", "fmt.Println"), ("pay.Charge", "pay.validate"), ("pay.Charge", "s.limit"), ("pay.Charge", "pay.inner"), ("pay.Get", "pay.convert")}
    lines = {x["name"]: x["line"] for x in e.collect()}
    assert SERVICE.split("\n")[lines["pay.validate"]].startswith("func validate")


def test_replies(spark):  # noqa: ANN001
    rows = [(1, "s1", 'Sure: {"entities": [{"name": "A", "type": "t", "observations": ["x", "y"]}, {"name": " "}, {"name": "B"}], "relations": [{"from": "A", "to": "B", "label": "uses"}, {"from": "A"}]} done'), (2, "s2", "no json {"), (3, "s3", None)]
    facts, edges = extraction.ingest_replies(spark.createDataFrame(rows, "id int, session string, reply string"), ["id"], "session")
    assert sorted((r["id"], r["name"], r["text"] or "", r["source"]) for r in facts.collect()) == [(1, "A", "x", "s1"), (1, "A", "y", "s1"), (1, "B", "", "s1")]
    assert [tuple(r) for r in edges.collect()] == [(1, 0, "A", "B", "uses")]


def test_a_model_that_fails(spark):  # noqa: ANN001
    def model(texts: list[str]) -> list[str]:
        if "bad" in texts:
            raise ValueError("no")
        return [f'{{"entities": [{{"name": "{t}"}}]}}' for t in texts]

    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c", " ", None, "d"])], "id int, text string").coalesce(1)
    got = {r["id"]: ([e["name"] for e in r["entities"]], r["error"]) for r in extraction.extractor(model, batch=2, retries=2, wait=0.0)(items).collect()}
    assert got == {0: (["a"], None), 1: ([], "ValueError: no"), 2: (["c"], None), 3: ([], None), 4: ([], None), 5: (["d"], None)}


def test_routed_relations_follow(spark):  # noqa: ANN001
    m = spark.createDataFrame([("n", "A"), ("n", "Noise"), ("n", "infra "), ("m", "INFRA")], "namespace string, name string")
    r = spark.createDataFrame([("n", "A", "noise", "x"), ("n", "a", "Infra", "y"), ("n", "A", "B", "z"), ("m", "Infra", "NOISE", "w")], "namespace string, src string, dst string, label string")
    name = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    facts, edges = archive.route_entities(m, r, name("noise", "NOISE"), name("infra", "noise"))
    assert sorted(tuple(x) for x in facts.collect()) == [("_global_", "INFRA"), ("_global_", "infra "), ("n", "A")]
    assert sorted(tuple(x) for x in edges.collect()) == [("_global_", "a", "Infra", "y"), ("n", "A", "B", "z")]


def test_titles(spark):  # noqa: ANN001
    rows = spark.createDataFrame([("n", "s1"), ("m", "s1"), ("n", "code:a.go"), ("n", None), ("n", "s2")], "namespace string, source string")
    titles = spark.createDataFrame([("n", "s1", "Talk"), ("n", "s1", "Talk again"), ("n", "s2", " ")], "namespace string, id string, title string")
    got = {(r["namespace"], r["source"]): r["title"] for r in archive.resolve_titles(materialize(rows), titles).collect()}
    assert got == {("n", "s1"): "Talk", ("m", "s1"): "s1", ("n", "code:a.go"): "代码 a.go", ("n", None): None, ("n", "s2"): "s2"}
