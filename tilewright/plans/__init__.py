"""Plan pieces shared by the operators: staging, global order, components, suppression."""
