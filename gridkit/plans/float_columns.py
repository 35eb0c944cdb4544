"""DOUBLE output columns per registered query (generated by tools/gen_float_columns.py)."""

FLOAT_COLUMNS = {'c09_invoice_check': ['line_sum', 'stated_total', 'difference'],
 'c10_vendor_cost_ratio': ['avg_emergency', 'avg_comparable', 'ratio'],
 'c11_threshold_conflicts': ['lowest', 'highest'],
 'c12_threshold_bands': ['running_mean'],
 'c13_rate_card_cost': ['labor_cost_usd', 'parts_billed_usd', 'billed_usd'],
 'c14_approval_tier': ['billed_usd'],
 'c15_doc_vs_table': ['stated', 'from_tables', 'difference'],
 'c17_indexed_neighbours': ['score'],
 'c17_indexed_topk': ['score'],
 'c17_topk_retrieval': ['score'],
 'd02_assets_per_site': ['asset_capacity_mw'],
 'd03_outage_duration_loss': ['duration_hours', 'derived_lost_mwh'],
 'd04_loss_per_day': ['lost_mwh'],
 'd05_loss_per_hour': ['lost_mwh'],
 'd06_cost_per_day': ['parts_cost_usd'],
 'd07_asset_pnl': ['gen_mwh',
                   'net_gen_mwh',
                   'revenue_usd',
                   'opex_usd',
                   'maintenance_cost_usd',
                   'profit_margin_pct',
                   'curtailed_mwh'],
 'd08_curtailment': ['curtailed_mwh'],
 'd09_power_sales': ['energy_sold_mwh', 'market_price', 'total_revenue'],
 'd10_region_day_price': ['avg_price'],
 'd11_work_order_class': ['labor_hours', 'parts_cost_usd'],
 'd14_anomaly_probability': ['predicted_failure_probability'],
 'g01_top_outage_assets': ['downtime_hours', 'efficiency_pct'],
 'g02_region_instability': ['risk_score'],
 'g03_capacity_factor_trend': ['capacity_factor', 'power_mwh'],
 'g04_mtbf_mttr': ['mtbf', 'mttr'],
 'g05_risky_assets': ['efficiency'],
 'g06_loss_root_causes': ['total_lost_mwh', 'avg_lost_mwh'],
 'g07_asset_profitability': ['revenue', 'net_profit', 'margin_pct'],
 'g08_region_revenue_loss': ['rev_loss', 'lost_mwh', 'revenue'],
 'g09_margin_by_quarter': ['revenue', 'profit', 'margin'],
 'g10_price_volatility': ['avg_price', 'price_volatility'],
 'g11_profit_bands': ['revenue', 'net_profit', 'avg_margin_pct'],
 'g12_costliest_outages': ['lost_mwh'],
 'g13_pm_ratio': ['ratio'],
 'g14_technician_load': ['labor_hrs', 'parts_cost'],
 'g16_backlog': ['overdue_pct'],
 'g18_repair_duration': ['avg_repair_hrs', 'avg_labor_hrs'],
 'm04_executive_coarse_cube': ['total_revenue_usd',
                               'net_profit_usd',
                               'profit_margin_pct',
                               'maintenance_cost_usd',
                               'total_generation_mwh',
                               'avg_efficiency_pct',
                               'capacity_factor_pct',
                               'total_downtime_hours',
                               'total_lost_mwh',
                               'preventive_to_reactive_ratio',
                               'grid_instability_risk_score'],
 'm04_executive_fine_cube': ['total_revenue_usd',
                             'net_profit_usd',
                             'profit_margin_pct',
                             'maintenance_cost_usd',
                             'total_generation_mwh',
                             'avg_efficiency_pct',
                             'capacity_factor_pct',
                             'total_downtime_hours',
                             'total_lost_mwh',
                             'preventive_to_reactive_ratio',
                             'grid_instability_risk_score'],
 'm04_finance_coarse_cube': ['total_revenue_usd',
                             'total_opex_usd',
                             'total_maintenance_cost_usd',
                             'net_profit_usd',
                             'profit_margin_pct',
                             'revenue_loss_from_outages_usd',
                             'curtailment_loss_mwh',
                             'revenue_per_mwh',
                             'total_lost_mwh'],
 'm04_finance_fine_cube': ['total_revenue_usd',
                           'total_opex_usd',
                           'total_maintenance_cost_usd',
                           'net_profit_usd',
                           'profit_margin_pct',
                           'revenue_loss_from_outages_usd',
                           'curtailment_loss_mwh',
                           'revenue_per_mwh',
                           'total_lost_mwh'],
 'm04_grid_coarse_cube': ['avg_temperature',
                          'max_temperature',
                          'avg_vibration',
                          'avg_efficiency_pct',
                          'total_power_generated_mwh',
                          'total_downtime_hours',
                          'mttr_hours',
                          'mtbf_hours',
                          'capacity_factor_pct',
                          'grid_instability_risk_score'],
 'm04_grid_fine_cube': ['avg_temperature',
                        'max_temperature',
                        'avg_vibration',
                        'avg_efficiency_pct',
                        'total_power_generated_mwh',
                        'total_downtime_hours',
                        'mttr_hours',
                        'mtbf_hours',
                        'capacity_factor_pct',
                        'grid_instability_risk_score'],
 'm04_maintenance_coarse_cube': ['preventive_to_reactive_ratio',
                                 'avg_repair_duration_hours',
                                 'avg_labor_hours',
                                 'total_labor_hours',
                                 'total_parts_cost_usd'],
 'm04_maintenance_fine_cube': ['preventive_to_reactive_ratio',
                               'avg_repair_duration_hours',
                               'avg_labor_hours',
                               'total_labor_hours',
                               'total_parts_cost_usd'],
 'm04_routed_filter': ['mtbf_hours',
                       'avg_vibration',
                       'grid_instability_risk_score',
                       'capacity_factor_pct'],
 'm04_routed_quarter': ['profit_margin_pct', 'revenue_loss_from_outages_usd'],
 'm04_routed_total': ['avg_temperature',
                      'max_temperature',
                      'avg_vibration',
                      'avg_efficiency_pct',
                      'total_power_generated_mwh',
                      'total_downtime_hours',
                      'mttr_hours',
                      'mtbf_hours',
                      'capacity_factor_pct',
                      'grid_instability_risk_score'],
 'n01_problem_assets': ['total_lost_mwh', 'est_revenue_loss_usd'],
 'n02_region_outages': ['lost_mwh'],
 'n03_monthly_outages': ['total_lost_mwh'],
 'n04_vendor_reliability': ['total_lost_mwh', 'avg_lost_per_outage', 'emergency_parts_cost_usd'],
 'n05_worst_outages': ['lost_mwh'],
 'n06_region_sites': ['capacity_mw'],
 'n07_region_pnl': ['revenue', 'opex', 'maint_cost', 'net_profit', 'margin_pct'],
 'n08_repeat_offenders': ['total_lost_mwh'],
 'q01_asset_mix': ['avg_crit'],
 'q02_site_mix': ['total_mw'],
 'q03_price_by_month': ['avg_price'],
 'q04_price_by_hour': ['avg_price'],
 'q05_anomaly_outage_buckets': ['avg_forced_outages'],
 'q06_loss_by_reason': ['avg_lost_mwh', 'total_lost_mwh'],
 'q07_wo_linkage': ['avg_labor', 'avg_parts_cost', 'pct_with_outage_link'],
 'q08_outage_price_impact': ['avg_lost_mwh', 'avg_revenue_loss_usd', 'total_revenue_loss_usd'],
 'q09_age_vs_financials': ['avg_margin', 'avg_daily_rev', 'avg_daily_maint'],
 'q10_causal_chain': ['severity_score'],
 'q11_overdue_vs_outages': ['avg_forced_outages'],
 'q12_outage_context': ['lost_mwh'],
 'r01_asset_capacity': ['asset_capacity_mw'],
 'r02_telemetry_daily': ['avg_temperature',
                         'max_temperature',
                         'avg_vibration',
                         'max_vibration',
                         'avg_efficiency_pct',
                         'total_power_mwh',
                         'voltage_stddev'],
 'r03_anomalies_daily': ['max_severity_score'],
 'r04_outages_daily': ['total_downtime_hours', 'total_lost_mwh'],
 'r04m_merged_outages': ['lost_mwh', 'downtime_hours'],
 'r05_work_orders_daily': ['total_labor_hours', 'total_parts_cost'],
 'r08_asset_daily_summary': ['asset_capacity_mw',
                             'theoretical_max_daily_mwh',
                             'revenue_usd',
                             'opex_usd',
                             'finance_maintenance_cost_usd',
                             'curtailed_mwh',
                             'net_profit_usd',
                             'profit_margin_pct',
                             'avg_temperature',
                             'max_temperature',
                             'avg_vibration',
                             'max_vibration',
                             'avg_efficiency_pct',
                             'total_power_mwh',
                             'voltage_stddev',
                             'max_severity_score',
                             'total_downtime_hours',
                             'total_lost_mwh',
                             'total_labor_hours',
                             'wo_total_parts_cost'],
 'r08_incremental_asset_days': ['asset_capacity_mw',
                                'theoretical_max_daily_mwh',
                                'revenue_usd',
                                'opex_usd',
                                'finance_maintenance_cost_usd',
                                'curtailed_mwh',
                                'net_profit_usd',
                                'profit_margin_pct',
                                'avg_temperature',
                                'max_temperature',
                                'avg_vibration',
                                'max_vibration',
                                'avg_efficiency_pct',
                                'total_power_mwh',
                                'voltage_stddev',
                                'max_severity_score',
                                'total_downtime_hours',
                                'total_lost_mwh',
                                'total_labor_hours',
                                'wo_total_parts_cost'],
 'r09_incremental_region_days': ['total_revenue_usd',
                                 'total_opex_usd',
                                 'total_maintenance_cost_usd',
                                 'total_curtailed_mwh',
                                 'net_profit_usd',
                                 'avg_profit_margin_pct',
                                 'total_power_mwh',
                                 'total_theoretical_max_mwh',
                                 'avg_efficiency_pct',
                                 'total_downtime_hours',
                                 'total_lost_mwh',
                                 'total_labor_hours',
                                 'total_parts_cost'],
 'r09_region_daily_summary': ['total_revenue_usd',
                              'total_opex_usd',
                              'total_maintenance_cost_usd',
                              'total_curtailed_mwh',
                              'net_profit_usd',
                              'avg_profit_margin_pct',
                              'total_power_mwh',
                              'total_theoretical_max_mwh',
                              'avg_efficiency_pct',
                              'total_downtime_hours',
                              'total_lost_mwh',
                              'total_labor_hours',
                              'total_parts_cost'],
 's02_overwrite_table': ['lost_generation_mwh'],
 's04_ctas_asset_daily': ['asset_capacity_mw',
                          'theoretical_max_daily_mwh',
                          'revenue_usd',
                          'opex_usd',
                          'finance_maintenance_cost_usd',
                          'curtailed_mwh',
                          'net_profit_usd',
                          'profit_margin_pct',
                          'avg_temperature',
                          'max_temperature',
                          'avg_vibration',
                          'max_vibration',
                          'avg_efficiency_pct',
                          'total_power_mwh',
                          'voltage_stddev',
                          'max_severity_score',
                          'total_downtime_hours',
                          'total_lost_mwh',
                          'total_labor_hours',
                          'wo_total_parts_cost'],
 's05_temp_view_sql': ['total_lost_mwh'],
 'st01_alarm_stream': ['temperature', 'vibration'],
 'st02_daily_rollup_stream': ['avg_temperature', 'max_vibration'],
 'st02_replay_daily': ['avg_temperature', 'max_vibration'],
 't05_topn_criticality': ['criticality_score'],
 'v03_measure_status': ['value'],
 'w02_first_time_fix_90d': ['first_time_fix_pct'],
 'w05_sustained_72h': ['window_min'],
 'w06_running_mean_24h': ['vibration', 'running_mean'],
 'w07_consecutive_days': ['max_week_hours'],
 'x01_grid_by_asset_type': ['avg_temperature',
                            'max_temperature',
                            'avg_vibration',
                            'avg_efficiency_pct',
                            'total_power_generated_mwh',
                            'total_downtime_hours',
                            'mttr_hours',
                            'mtbf_hours',
                            'capacity_factor_pct',
                            'grid_instability_risk_score'],
 'x02_grid_health_risk': ['avg_efficiency_pct'],
 'x03_grid_by_region': ['total_power_generated_mwh', 'capacity_factor_pct'],
 'x04_grid_by_month': ['total_power_generated_mwh', 'avg_efficiency_pct'],
 'x05_fin_by_region': ['total_revenue_usd',
                       'total_opex_usd',
                       'total_maintenance_cost_usd',
                       'net_profit_usd',
                       'profit_margin_pct',
                       'revenue_loss_from_outages_usd',
                       'curtailment_loss_mwh',
                       'revenue_per_mwh',
                       'total_lost_mwh'],
 'x06_fin_by_band': ['total_revenue_usd', 'net_profit_usd', 'profit_margin_pct'],
 'x07_fin_by_exposure': ['total_revenue_usd', 'revenue_per_mwh', 'revenue_loss_from_outages_usd'],
 'x08_fin_gen_quarter': ['total_revenue_usd', 'net_profit_usd', 'curtailment_loss_mwh'],
 'x09_maint_by_type': ['preventive_to_reactive_ratio',
                       'avg_repair_duration_hours',
                       'avg_labor_hours',
                       'total_labor_hours',
                       'total_parts_cost_usd'],
 'x10_maint_priority_status': ['avg_repair_duration_hours', 'total_parts_cost_usd'],
 'x11_maint_by_certification': ['avg_labor_hours', 'total_parts_cost_usd'],
 'x12_maint_region_type': ['total_parts_cost_usd'],
 'x13_maint_by_outage_reason': ['avg_repair_duration_hours'],
 'x14_exec_by_region': ['total_revenue_usd',
                        'net_profit_usd',
                        'profit_margin_pct',
                        'maintenance_cost_usd',
                        'total_generation_mwh',
                        'avg_efficiency_pct',
                        'capacity_factor_pct',
                        'total_downtime_hours',
                        'total_lost_mwh',
                        'preventive_to_reactive_ratio',
                        'grid_instability_risk_score'],
 'x15_exec_by_health': ['total_revenue_usd', 'avg_efficiency_pct'],
 'x16_exec_risk_gen': ['total_revenue_usd', 'net_profit_usd'],
 'x17_exec_quarter_gen': ['total_revenue_usd', 'total_generation_mwh'],
 'y02_fin_dimensions': ['total_revenue_usd', 'curtailment_loss_mwh'],
 'y03_maint_dimensions': ['total_labor_hours'],
 'y04_exec_dimensions': ['total_revenue_usd']}
