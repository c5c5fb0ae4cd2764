"""ticketlake: service-desk ticket analytics as Spark jobs.

Layers: ``sources`` (inputs, storage), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame steps), ``plans`` (session setup and the
layered build job), ``streaming`` (nothing: the modelled workload is batch).
"""

__all__ = ["config"]
