"""The catalog of services: registration, liveness, weights and discovery (a small control table on the driver)."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

KINDS = ("sql", "graph", "document")


@dataclass(frozen=True)
class Service:
    """What the catalog knows of a service. schema is what a translator is shown; secrets never belong here."""

    service_id: str
    kind: str
    name: str
    summary: str
    schema: dict = field(default_factory=dict)
    version: str = "1"
    vector: tuple[float, ...] | None = None
    weight: float = 0.0
    registered_at: float = 0.0
    heartbeat: float = 0.0
    active: bool = True

    def check(self) -> None:
        """Raises ValueError where the description breaks a rule."""
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if len(self.summary.split()) > 200:
            raise ValueError("a summary has at most 200 words")
        if not 0 <= self.weight <= 1:
            raise ValueError("a weight lies between 0 and 1")
        if self.vector is not None:
            if not self.summary:
                raise ValueError("a vector needs a summary")
            if abs(sum(x * x for x in self.vector) - 1) > 0.01:
                raise ValueError("a vector has length 1")


class Catalog:
    """Services by id. now is the clock, a parameter so that tests need not wait."""

    def __init__(self, timeout: float = 60.0, now: Callable[[], float] = time.time):
        self.timeout, self.now = timeout, now
        self._services: dict[str, Service] = {}
        self._started = False

    def register(self, service: Service) -> Service:
        """New services start with weight 0; a changed version gets an equal share, an unchanged one keeps what it has."""
        service.check()
        known = self._services.get(service.service_id)
        if known is None:
            service = replace(service, weight=0.0, registered_at=self.now(), heartbeat=self.now(), active=True)
        elif known.version == service.version:
            service = replace(service, weight=known.weight, registered_at=known.registered_at, heartbeat=known.heartbeat, active=True)
        else:
            others = sum(s.active for k, s in self._services.items() if k != service.service_id)
            service = replace(service, weight=1 / (others + 1), registered_at=known.registered_at, heartbeat=self.now(), active=True)
        self._services[service.service_id] = service
        return service

    def deregister(self, service_id: str) -> None:
        self._services[service_id] = replace(self._services[service_id], active=False)

    def heartbeat(self, service_id: str) -> None:
        self._services[service_id] = replace(self._services[service_id], heartbeat=self.now(), active=True)

    def expire(self) -> list[str]:
        """Ids of active services not heard of within the timeout, now inactive."""
        gone = [k for k, s in self._services.items() if s.active and self.now() - s.heartbeat > self.timeout]
        for k in gone:
            self.deregister(k)
        return gone

    def set_weight(self, service_id: str, weight: float) -> None:
        if not 0 <= weight <= 1:
            raise ValueError("a weight lies between 0 and 1")
        if service_id not in self._services:
            raise KeyError(service_id)
        self._services[service_id] = replace(self._services[service_id], weight=weight)

    def get(self, service_id: str) -> Service | None:
        return self._services.get(service_id)

    def all(self, active_only: bool = True) -> list[Service]:
        return [s for s in self._services.values() if s.active or not active_only]

    def __len__(self) -> int:
        return len(self._services)

    def discover(self, vector: list[float] | None = None, k: int = 10, least: float = 0.0, confirm: Callable[[list[Service]], list[str] | None] | None = None) -> list[Service]:
        """Services for one question: stale ones expired, first weights given, nearest k kept, then confirmed.

        Without a vector all pass. confirm returns the ids to keep; None or nothing usable keeps all.
        For many questions at once see relevance.prefilter.
        """
        self.expire()
        active = self.all()
        if not self._started and active:
            self._started = True
            for s in active:
                if s.weight == 0.0:
                    self._services[s.service_id] = replace(s, weight=1 / len(active))
            active = self.all()
        if vector is not None:
            length = math.sqrt(sum(x * x for x in vector))
            if not length:
                raise ValueError("a zero vector has no direction")

            def near(s: Service) -> float:
                if s.vector is None or len(s.vector) != len(vector):
                    return 1.0
                return sum(a * b for a, b in zip(vector, s.vector)) / length

            active = [s for s in sorted(active, key=near, reverse=True)[:k] if near(s) >= least]
        if confirm is not None:
            kept = confirm(active)
            if kept is not None:
                active = [s for s in active if s.service_id in kept]
        return active
