"""A process manager: a stream that keeps a to-do list, and a reaction that works it off through other streams.

The group checkout: stays are selected, each is charged to the group or fails, and once none is pending the group pays
what is left and is confirmed. The reaction returns the version it has brought the stream to, so that events which it
wrote itself are not handled again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from ..sources.store import Event
from .decider import Category


@dataclass(frozen=True)
class Stay:
    """A guest's account: its balance, and whether it is closed or transferred to a group."""

    balance: int = 0
    charges: frozenset = frozenset()
    payments: frozenset = frozenset()
    closed: bool = False
    group: str | None = None


def stay_step(s: Stay, e: Event) -> Stay:
    d = json.loads(e.data or "{}")
    match e.type:
        case "Charged":
            return replace(s, balance=s.balance + d["amount"], charges=s.charges | {d["id"]})
        case "Paid":
            return replace(s, balance=s.balance - d["amount"], payments=s.payments | {d["id"]})
        case "CheckedOut":
            return replace(s, closed=True)
        case "TransferredToGroup":
            return replace(s, closed=True, group=d["group"], balance=0)
    return s


def charge(id_: str, amount: int):
    """A charge with an id that was seen changes nothing; one to a closed stay is refused."""

    def decide(s: Stay):
        if s.closed:
            raise ValueError("the stay is closed")
        return [] if id_ in s.charges else [Event("Charged", json.dumps({"id": id_, "amount": amount}))]

    return decide


def pay(id_: str, amount: int):
    def decide(s: Stay):
        return [] if id_ in s.payments else [Event("Paid", json.dumps({"id": id_, "amount": amount}))]

    return decide


def check_out(s: Stay):
    """("ok" | "already" | "balance", events)"""
    if s.closed:
        return "already", []
    if s.balance:
        return "balance", []
    return "ok", [Event("CheckedOut")]


def transfer(group: str):
    """((ok, residual), events): a stay goes to one group only; asking again for the same one gives what it gave."""

    def decide(s: Stay):
        if s.group == group:
            return (True, 0), []
        if s.closed:
            return (False, 0), []
        return (True, s.balance), [Event("TransferredToGroup", json.dumps({"group": group, "residual": s.balance}))]

    return decide


@dataclass(frozen=True)
class Checkout:
    pending: tuple = ()
    merged: tuple = ()
    failed: tuple = ()
    payments: frozenset = frozenset()
    balance: int = 0
    done: bool = False

    @property
    def action(self) -> str:
        if self.done:
            return "finished"
        if self.pending:
            return "merge"
        return "ready" if self.balance == 0 else "pay"


def checkout_step(s: Checkout, e: Event) -> Checkout:
    d = json.loads(e.data or "{}")
    match e.type:
        case "StaysSelected":
            return replace(s, pending=s.pending + tuple(d["stays"]))
        case "StaysMerged":
            gone = {r["stay"] for r in d["residuals"]}
            return replace(s, pending=tuple(x for x in s.pending if x not in gone), merged=s.merged + tuple(gone), balance=s.balance + sum(r["residual"] for r in d["residuals"]))
        case "MergesFailed":
            return replace(s, pending=tuple(x for x in s.pending if x not in d["stays"]), failed=s.failed + tuple(d["stays"]))
        case "Paid":
            return replace(s, payments=s.payments | {d["id"]}, balance=s.balance - d["amount"])
        case "Confirmed":
            return replace(s, done=True)
    return s


def select_stays(stays: list[str]):
    """Stays that the group has not registered yet are added."""

    def decide(s: Checkout):
        known = {*s.pending, *s.merged, *s.failed}
        fresh = [x for x in dict.fromkeys(stays) if x not in known]
        return [Event("StaysSelected", json.dumps({"stays": fresh}))] if fresh else []

    return decide


def confirm(s: Checkout):
    """((ok, failed), events): confirmed only when nothing is pending or owed."""
    if s.done:
        return (len(s.merged), len(s.failed)), []
    if s.action != "ready":
        return None, []
    return (len(s.merged), len(s.failed)), [Event("Confirmed")]


@dataclass
class GroupCheckout:
    store: object
    stays: Category = field(init=False)
    groups: Category = field(init=False)

    def __post_init__(self):
        fold = lambda step: lambda s, es: reduce(step, es, s)
        self.stays = Category(self.store, "GuestStay", fold(stay_step), Stay())
        self.groups = Category(self.store, "GroupCheckout", fold(checkout_step), Checkout())

    def react(self, group: str) -> tuple[str, int]:
        """Works off what is pending; the result of a handler: the version to go on from."""
        decider = self.groups.decider(group)
        state = decider.query()
        if state.action == "merge":
            done = {s: self.stays.decider(s).transact(transfer(group), result=True) for s in state.pending}
            good = [{"stay": s, "residual": r} for s, (ok, r) in done.items() if ok]
            bad = [s for s, (ok, _) in done.items() if not ok]

            def record(s: Checkout):
                now = set(s.pending)
                merged = [g for g in good if g["stay"] in now]
                failed = [b for b in bad if b in now]
                events = [Event("StaysMerged", json.dumps({"residuals": merged}))] if merged else []
                return events + ([Event("MergesFailed", json.dumps({"stays": failed}))] if failed else [])

            decider.transact(record)
        return "override", decider.query(lambda x: x.version, context=True)
