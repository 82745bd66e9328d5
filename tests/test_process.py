import random

import pytest

from rillstone.operators import process as P
from rillstone.sources.store import MemoryStore


def stay(flow, name):
    return flow.stays.decider(name)


def test_stays():
    flow = P.GroupCheckout(MemoryStore())
    s = stay(flow, "1")
    assert s.transact(P.charge("c1", 30)) == 1
    assert s.transact(P.charge("c1", 30)) == 1
    assert s.transact(P.check_out, result=True) == "balance"
    s.transact(P.pay("p1", 30))
    s.transact(P.pay("p1", 30))
    assert s.query().balance == 0
    assert s.transact(P.check_out, result=True) == "ok" and s.transact(P.check_out, result=True) == "already"
    with pytest.raises(ValueError, match="closed"):
        s.transact(P.charge("c2", 1))


@pytest.mark.parametrize("seed", range(8))
def test_a_group_checks_out(seed):
    rnd = random.Random(seed)
    flow = P.GroupCheckout(MemoryStore())
    amounts = {f"s{k}": rnd.randint(0, 99) for k in range(rnd.randint(0, 9))}
    for name, amount in amounts.items():
        stay(flow, name).transact(P.charge("c", amount))
    closed = {n for n in amounts if rnd.random() < 0.3}
    for n in closed:
        stay(flow, n).transact(P.pay("p", amounts[n]))
        stay(flow, n).transact(P.check_out, result=True)
    group = flow.groups.decider("g")
    group.transact(P.select_stays([*amounts, *amounts]))
    before = group.query().action
    kind, version = flow.react("g")
    assert kind == "override" and version == group.query(lambda x: x.version, context=True)
    assert flow.react("g") == (kind, version)
    state = group.query()
    owed = sum(a for n, a in amounts.items() if n not in closed)
    assert before == ("merge" if amounts else "ready") and state.balance == owed and set(state.failed) == closed
    if owed:
        assert group.transact(P.confirm, result=True) is None and state.action == "pay"
        group.transact(lambda s: P.pay("x", owed)(P.Stay()))
    assert group.transact(P.confirm, result=True) == (len(amounts) - len(closed), len(closed))
    assert group.query().action == "finished" and group.transact(P.confirm, result=True) == (len(amounts) - len(closed), len(closed))
