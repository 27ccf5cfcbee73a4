"""Stateful processing in batch form: idempotency, leases, quotas, circuits, uploads, imports."""
