from plantlog.plans.topology import Catalog, build_topology

__all__ = ["Catalog", "build_topology"]
