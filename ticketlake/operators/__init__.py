"""DataFrame -> DataFrame operators of the ticket analytics workload."""
